"""Operators on single texts, sources, classifiers and the pipeline."""

import collections
import math
import os
import random
import time
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from waylattice.llm import chat
from waylattice.llm.common import Powers, crc_mod, key_order, shared_dir, word_runs
from waylattice.llm.mixing import mix_sources, source_targets
from waylattice.llm.quality import accepted, fit_quality, quality_scores, statistics, statistics_table
from waylattice.llm.quality import labelled as labelled_rows
from waylattice.llm import suffix_tree
from waylattice.llm.suffix_tree import TreeConfig, score_texts
from waylattice.llm.toxicity import Folding, Lexicon, LexiconConfig, calibrate, folded, measures, toxicity_scores
from waylattice.llm.url_filter import LONG, RULES, Automaton, Rule, filter_urls


# --- urls ---


def glob_regex(glob):
    out = ""
    for part in re.findall(r"\*+|\?|[^*?]+", glob):
        out += ".*" if part.startswith("**") else "[^/]*" if part == "*" else "[^/]" if part == "?" else re.escape(part)
    return re.compile(out, re.S)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab/.*?", min_size=1, max_size=25), min_size=1, max_size=9), st.lists(st.text("ab/.é", max_size=30), min_size=1, max_size=20))
def test_automaton_is_the_globs(globs, urls):
    a = Automaton(globs)
    regexes = [glob_regex(g) for g in globs]
    want = [next((i for i, r in enumerate(regexes) if r.fullmatch(u)), -1) for u in urls]
    assert a.match(urls).tolist() == want
    assert a.match([u + "/" * (LONG + 1) for u in urls]).tolist() == [next((i for i, r in enumerate(regexes) if r.fullmatch(u + "/" * (LONG + 1))), -1) for u in urls]


def test_url_rules(spark):
    urls = [
        "http://www.Example.ORG/es/1", "https://example.org/en/19?x", "https://notexample.org/en/1", "http://a.com/fr/", "http://com/de/x", "http://x.net/example.org/es/", "http://example.org", None, "no scheme", "://", "http://example.org?/es/", "http://b.org/es/",
    ]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(df, RULES).collect()}
    assert got[0] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/19", "example.org/en/1", "block")
    assert got[2] == ("notexample.org", "/en/1", "org/", "allow")
    assert got[3][2:] == ("com/fr/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[5] == ("x.net", "/example.org/es/", None, "allow") and got[6] == ("example.org", "", None, "allow")
    assert got[7] == ("", "", None, "allow") == got[8] == got[9] and got[10] == ("example.org", "", None, "allow") and got[11][2] == "org/"
    assert filter_urls(df.limit(0), RULES).count() == 0 and filter_urls(df, [], "block").where("verdict = 'block'").count() == len(urls)
    assert [r["rule"] for r in filter_urls(spark.createDataFrame([("http://a.com/xZy",), ("http://a.com/x?y",), ("http://a.com/x*y/1",), ("http://a.com/xy/",), ("http://a.com/x\\\\y",)], "url string"), [Rule.of("a.com", p, "block") for p in ("/x?y", "/x*y", "/x\\\\y")]).collect()] == [None, None, "a.com/x*y", None, "a.com/x\\\\y"]
    many = [Rule.of(f"h{i}.net", f"/p{i}/", "block") for i in range(100)]
    assert filter_urls(spark.createDataFrame([("http://h77.net/p77/x",)], "url string"), many).first()["rule"] == "h77.net/p77/"


# --- chat ---


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "s<|says|>", ""]), st.text(st.sampled_from("\\<|[]/>sINSTturnend \n") | st.characters(codec="utf-8"), max_size=30)), max_size=6))
def test_chat_round_trip(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert "".join(chat.unescape(text[s:e]) for s, e in spans) == "".join(t for r, t in turns if r == "assistant")
    for r, t in turns:
        assert not re.search(r"<\||</?s>|\[/?INST\]", chat.escape(t)) and chat.unescape(chat.escape(t)) == t


def test_layouts(spark):
    records = [
        (1, None, '{"prompt": "p", "completion": "c"}'), (2, None, '{"instruction": "i", "input": "", "output": "o"}'), (3, None, '{"messages": [{"role": "user", "content": "u"}, {"content": "a", "role": "assistant"}]}'),
        (4, None, '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}], "extra": {"x": 1}}'), (5, None, '{"unknown": 1}'), (6, None, "not json"), (7, 1, '{"conv_id": 7, "turn": 1, "role": "assistant", "text": null}'),
        (7, 0, '{"conv_id": 7, "turn": 0, "role": "human", "text": "q"}'), (None, None, '{"prompt": "n", "response": "r"}'), (8, None, None), (9, None, '{"messages": []}'),
    ]
    out = chat.format_conversations(spark.createDataFrame(records, "id long, seq long, record string"))
    got = {r["id"]: chat.parse(r["formatted"]) for r in out.collect()}
    assert got[1] == [("user", "p"), ("assistant", "c")] and got[2] == [("user", "i"), ("assistant", "o")] and got[3] == [("user", "u"), ("assistant", "a")]
    assert got[4] == [("user", "h"), ("assistant", "g")] and got[5] == got[6] == got[8] == got[9] == [] and got[7] == [("human", "q"), ("assistant", "")] and got[None] == [("user", "n"), ("assistant", "r")]
    assert chat.format_conversations(spark.createDataFrame([], "id long, seq long, record string")).count() == 0


# --- language model ---


def docs_of(seed, n=60):
    rng = random.Random(seed)
    syllables = ["ta", "ri", "mo", "né", "sul", "ke"]
    return [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def plain_model(texts, config):
    """By plain loops over every context: p(context, word), and the retained contexts."""
    data = [["<", *(t or "").encode().lower().split(), ">"] for t in texts]
    x = [collections.defaultdict(collections.Counter) for _ in range(config.depth + 1)]
    for s in data:
        for i in range(1, len(s)):
            for k in range(min(i, config.depth) + 1):
                x[k][tuple(s[i - k : i])][s[i]] += 1
    single = x[0][()]
    n, v = sum(single.values()), len(single)
    cache = {}

    def p(c, w):
        if not c:
            return (single[w] + 1) / (n + v + 1)
        if (c, w) not in cache:
            f = x[len(c)][c]
            own = {y: m for y, m in f.items() if m >= config.least}
            if not own:
                return p(c[1:], w)
            left = sum(f.values()) - sum(own.values()) + len(own)
            cache[c, w] = (own.get(w, 0) + left * p(c[1:], w)) / (sum(f.values()) + len(own))
        return cache[c, w]

    kept = {()}
    for k in range(1, config.depth + 1):
        for c, f in x[k].items():
            own, total = {y: m for y, m in f.items() if m >= config.least}, sum(f.values())
            q = {y: p(c[1:], y) for y in own}
            rest = total - sum(own.values())
            gain = sum(m * math.log(m / total / q[y]) for y, m in own.items())
            gain += rest * math.log(rest / total / max(1 - sum(q.values()), 1 / (n + v + 1))) if rest and own else 0
            if own and gain >= config.divergence:
                kept |= {c[i:] for i in range(k + 1)}
    return p, kept, single


def plain_scores(texts, train, config):
    p, kept, _ = plain_model(train, config)
    out = []
    for t in texts:
        s, score = ["<", *(t or "").encode().lower().split(), ">"], 0.0
        for i in range(1, len(s)):
            k = max(k for k in range(min(i, config.depth) + 1) if tuple(s[i - k : i]) in kept)
            score += math.log10(p(tuple(s[i - k : i]), s[i]))
        out.append(score)
    return out


def passages(seed, n=80):
    """Texts with phrases that recur in them, and words that occur once."""
    rng = random.Random(seed)
    phrases = ["of the", "in the end of the day", "At  last THE", "one two three four five six", "a rare pair", "of the old town"]
    return [" ".join(rng.choice(phrases) if rng.random() < 0.5 else rng.choice(["of", "the", "old", f"w{rng.randint(0, 400)}"]) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("least, divergence", [(2, 6.0), (3, 12.0)])
def test_tree_against_plain_loops(spark, least, divergence):
    rows = [*passages(3), None, "", "qzxqzv qzxqzv qzxqzv qzxqzv", "unseen words and of the old town", "Of\tthe\u00a0old " * 3_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], "doc_id long, text string, trained int")
    config = TreeConfig(depth=3, least=least, divergence=divergence)
    mask = crc_mod(7) != 2
    train = [t for i, t in enumerate(rows) if zlib.crc32(str(i).encode()) % 7 != 2]
    want = plain_scores(rows, train, config)
    kept = plain_model(train, config)[1]
    assert {len(c) for c in kept} == {0, 1, 2, 3}
    # all in the head, some of it, and none
    for most in ((500_000, 10_000, 10_000), (20, 12, 40), (0, 0, 0))[: 5 - least]:
        got = dict(score_texts(df, mask, config=config, head_words=most[0], head_contexts=most[1], head_next=most[2]).select("doc_id", "score").collect())
        assert [got[i] for i in range(len(rows))] == pytest.approx(want, rel=1e-9, abs=1e-9), most


def test_retained_contexts_are_distributions():
    config = TreeConfig(depth=3, divergence=4.0)
    p, kept, single = plain_model(passages(5), config)
    unseen = 1 - sum(p((), w) for w in single)
    for c in kept:
        rest = math.prod(p(c[i:], "never") / p(c[i + 1 :], "never") for i in range(len(c))) * unseen
        assert sum(p(c, w) for w in single) + rest == pytest.approx(1)


def test_base_scores_against_plain_counts(spark):
    rows = [*docs_of(2), None, "", "ONE  one\tOne", "x" * 30_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], "doc_id long, text string, trained int")
    got = {r["doc_id"]: r for r in score_texts(df, crc_mod(7) != 2, head_words=20).collect()}
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    c = collections.Counter(w for i, t in enumerate(rows) if zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(rows):
        w = tokens(t)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), abs=1e-6)
    untrained = score_texts(df.where("doc_id < 3"), F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["score"] == r["base_score"] == 0 for r in untrained)
    assert score_texts(df.limit(0), F.lit(True)).count() == 0


def test_the_tree_leaves_only_tables_that_its_result_reads(spark):
    df = spark.createDataFrame(list(enumerate(passages(4, 30))), "doc_id long, text string")
    folder = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    assert score_texts(df, F.lit(True)).count() == 30
    assert sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before) == ["lm-scored", "lm-words"]


def test_counts_of_a_task_take_few_bytes():
    # 200,000 different pairs of different contexts, half of them with a next word that was not seen: 18 bytes a pair of what is sent at once at most
    rng = np.random.default_rng(5)
    a, b = rng.integers(1, 1 << 64, 200_000, np.uint64), rng.integers(1, 1 << 64, 200_000, np.uint64)
    b[::2] = suffix_tree.NONE
    up = (b % np.uint64(7)).astype(np.int16)
    for level in (1, 2):
        sums = suffix_tree.Sums(7, level)
        assert not list(sums.add(a, b, up)) + list(sums.add(a[:50_000], b[:50_000], up[:50_000]))
        out = list(sums.out())
        assert max(x.nbytes for x in out) <= suffix_tree.SENT and not list(sums.out())
        assert sum(x.column("a").nbytes + x.column("b").nbytes for x in out) <= (20 if level == 1 else 13) * len(a)
        got = collections.Counter()
        for x in out:
            of = lambda c, kind, x=x: suffix_tree.unpacked(pa.chunked_array([x.column(c)]), kind)  # noqa: B023, E731
            if level == 2:
                assert of("x", np.int32).sum() > 0 and (of("up", np.int16) < 7).all()
                for pair, n in zip(zip(np.repeat(of("a", np.uint64), of("many", np.int32)).tolist(), of("b", np.uint64).tolist(), strict=True), of("times", np.int32).tolist(), strict=True):
                    got[pair] += n
        if level == 2:
            assert got == collections.Counter(zip(a[1::2].tolist(), b[1::2].tolist(), strict=True)) + collections.Counter(zip(a[1:50_000:2].tolist(), b[1:50_000:2].tolist(), strict=True))


def test_pairs_and_first_hashes_are_sorted_together():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 1 << 64, 300, np.uint64)[rng.integers(0, 300, 20_000)], rng.integers(0, 1 << 64, 90, np.uint64)[rng.integers(0, 90, 20_000)]
    order = suffix_tree.pair_order(a, b, 2)
    x, y = a[order], b[order]
    assert sorted(order.tolist()) == list(range(20_000)) and 1 + (x[1:] != x[:-1]).sum() == len(set(a.tolist()))
    assert 1 + ((x[1:] != x[:-1]) | (y[1:] != y[:-1])).sum() == len(set(zip(a.tolist(), b.tolist(), strict=True)))


def test_rows_of_symbols_beyond_the_head_may_lie_far_apart(spark, monkeypatch):
    rows = [x for t in passages(6, 40) for x in (t, "")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").coalesce(1)
    want = dict(score_texts(df, F.lit(True)).select("doc_id", "score").collect())
    for chains, apart in ((500_000, 4), (50, 1 << 16)):
        monkeypatch.setattr(suffix_tree, "CHAINS", chains)
        monkeypatch.setattr(suffix_tree, "CHAIN_ROWS", apart)
        assert dict(score_texts(df, F.lit(True), head_words=5, head_contexts=5, head_next=20).select("doc_id", "score").collect()) == pytest.approx(want, rel=1e-9)


def test_hashes_are_sorted_also_if_they_agree_in_their_leading_bits():
    rng = np.random.default_rng(3)
    for keys in (np.empty(0, np.uint64), rng.integers(0, 1 << 64, 5_000, np.uint64), rng.integers(0, 40, 5_000).astype(np.uint64)):
        assert (keys[key_order(keys)] == np.sort(keys)).all() and sorted(key_order(keys).tolist()) == list(range(len(keys)))


def test_rare_contexts_count_in_a_large_corpus(spark):
    # three occurrences in 250,000 words
    rows = ["ta " * 250_000, "qzx vyk qzx vyk qzx vyk"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    r = dict(score_texts(df, F.lit(True)).select("doc_id", F.col("score") - F.col("base_score")).collect())
    assert r[1] > 10


def test_tree_beats_unigrams_on_unseen_texts(spark):
    rows = [(i, t) for i, t in enumerate(passages(8, 300))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    r = score_texts(df, crc_mod(7) != 2).where("not trained").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.8 * r[1]  # scores are negative: a fifth of the base is saved


def test_words_are_hashed_alike_wherever_they_stand():
    texts = [b"", b"One two", b" two\tONE\x0b", b"onetwo", b"", b"\xc3\x89 two", b"x" * 3_000_000 + b" two", b"  "]
    got = list(word_runs(pa.array(texts, pa.binary()), Powers()))
    counts, hashes = np.concatenate([c for _, c in got]), np.concatenate([h for h, _ in got])
    words = [w for t in texts for w in t.lower().split()]
    assert counts.tolist() == [len(t.lower().split()) for t in texts] and len(got) > 1
    assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))


# --- mixing ---


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in full]
        rest = total - sum(full.values())
        share = {s: rest * w[s] / sum(w[x] for x in left) for s in left} if left else {}
        over = [s for s in left if share[s] > most * sizes[s]]
        if not over:
            return full | share
        full |= {s: most * sizes[s] for s in over}


def test_targets_are_the_reshared_ones(spark):
    rng = random.Random(4)
    for k in (1, 2, 5, 40):
        sizes = {f"s{i}": int(10 ** rng.uniform(0, 4)) for i in range(k)} | ({None: 7} if k > 2 else {})
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in source_targets(df).collect()}
        assert got == pytest.approx(plain_targets(sizes))


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "c", "d", None]), " ".join("w" * rng.randint(0, 40)), 3) for i in range(2000)]
    rows += [(5000, "a", None, 3), (5001, "e", "", 3), (None, "b", "x y", 3), (7, "a", "same row", 3), (7, "a", "same row", 3)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    got = mix_sources(df).collect()
    again = mix_sources(df.repartition(13)).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    assert sum(r["taken"] for r in got) == sum(r["size"] for r in got)
    by = collections.defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]] += r["taken"]
    for r in got:
        assert abs(by[r["source"]] - r["target"]) <= 90
    as_text = mix_sources(df.withColumn("doc_id", F.concat(F.lit("id-"), F.col("doc_id").cast("string"))))
    assert as_text.schema["doc_id"].dataType.simpleString() == "string" and as_text.count() == len(got)
    assert as_text.agg(F.sum("taken")).first()[0] == sum(r["taken"] for r in got)
    assert mix_sources(df.limit(0)).count() == 0 and mix_sources(df.where("doc_id = 5000")).first()["taken"] == 0


# --- classifiers ---


def labelled(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        n = rng.randint(3, 80)
        words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(1, 8))) for _ in range(n)]
        good, toxic = i % 4 != 0, i % 5 == 1
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["zorgle", "Z0RGLE", "zоrgle", "fleembat", "fleembic"]))
        text = " ".join(words).capitalize() + "." if good else " ".join(["BUY"] * n) if i % 8 else " ".join(f"{w}$$%%" for w in words)
        if toxic and not good:
            text += " zorgle fleembos"
        rows.append((i, text, 0.5))
        labels.append((i, int(good), int(toxic)))
    rows += [(9000, None, 0.5), (9001, "", 0.5), (None, "text without an id", 0.5), (9002, "word " * 50_000, 0.5)]
    labels += [(3, None, None), (9000, 5, 5), (0, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, column, least):
    held = scored.where("not trained").join(labels.where(f"{column} in (0, 1)"), "doc_id")
    return held.agg(F.avg(((F.col("score") >= least).cast("int") == F.col(column)).cast("double"))).first()[0]


def test_quality(spark):
    docs, labels = labelled(spark)
    scored = quality_scores(docs, labels, crc_mod(4) != 2)
    assert scored.count() == docs.count() and accuracy(scored, labels, "quality", 0.7) > 0.97
    assert scored.where("score is null or isnan(score) or score < 0 or score > 1").count() == 0
    assert {r["score"] for r in quality_scores(docs, labels.limit(0), crc_mod(4) != 2).collect()} == {0.5}
    assert quality_scores(docs.limit(0), labels, crc_mod(4) != 2).count() == 0
    kept = accepted(docs, fit_quality(statistics_table(docs, crc_mod(4) != 2), labels))
    assert kept.columns == docs.columns and 400 < kept.count() < 500


def test_toxicity(spark):
    docs, labels = labelled(spark)
    scored = toxicity_scores(docs, labels, crc_mod(5) != 0)
    assert scored.count() == docs.count() and accuracy(scored, labels, "toxic", 0.5) > 0.97
    assert scored.where("score is null or isnan(score) or score < 0 or score > 1").count() == 0
    assert {r["score"] for r in toxicity_scores(docs, labels.where("toxic = 0"), crc_mod(5) != 0).collect()} == {0.0}
    assert toxicity_scores(docs.limit(0), labels, crc_mod(5) != 0).count() == 0


#: Phrases that a caller gives.
GIVEN = ("trash can", "trash bin", "pond scum")


def test_folding_and_exceptions():
    fold = Folding()
    assert folded("M0R0N", fold) == folded("mоrоn", fold) == folded("mo\u200bron", fold) == " moron "
    lexicon = Lexicon({folded("trash", fold): 2.0, folded("scum", fold).rstrip(): 1.0}, GIVEN)
    assert lexicon.match("trash, TRA5H and scummy")[:2] == (5.0, 3)
    assert lexicon.match("a trash can of pond scum")[:2] == (0.0, 0)
    assert lexicon.match("")[:3] == (0.0, 0, 0) and lexicon.match("strash")[1] == 0


def test_matching_is_linear_in_long_texts():
    """A text with many exceptions: eight times the words may take no more than some twenty times as long."""
    lexicon = Lexicon({" trash ": 1.0}, GIVEN)
    took = []
    for n in (5_000, 40_000):
        text = "trash can trash x " * n
        start = time.perf_counter()
        assert lexicon.match(text)[:2] == (float(n), n)
        took.append(time.perf_counter() - start)
    assert took[1] < 20 * took[0]


def plain_toxicity(rows, labels, config):
    """Weight, words found and all words of each text, and its score: patterns counted and matched by plain substring search."""
    fold = Folding()
    flat = [folded(t or "", fold) for _, t in rows]
    train = [(i, y) for i, (d, _) in enumerate(rows) for y in {labels.get(d)} if y is not None and zlib.crc32(str(d).encode()) % 5]
    texts = {y: {rows[i][1] or "" for i, z in train if z == y} for y in (0, 1)}

    def telling(find, among=lambda t: True):
        n = {y: collections.Counter(p for t in texts[y] for p in find(folded(t, fold))) for y in (0, 1)}
        toxic, clean = (sum(among(folded(t, fold)) for t in texts[y]) for y in (1, 0))
        for p in n[0] | n[1]:
            t, c = n[1][p], n[0][p]
            odds = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
            proof = sum(m * math.log(m * (toxic + clean) / ((t + c) * of)) for m, of in ((t, toxic), (c, clean)) if m)
            if proof >= config.least_evidence and abs(odds) >= config.least_odds:
                yield p, odds, t

    def patterns(t):
        return {q for w in t.split() for q in (f" {w} ", *(f" {w[:k]}" for k in range(config.prefix[0], min(config.prefix[1], len(w) - 1) + 1)))}

    weights = {}
    for p, odds, _ in sorted((x for x in telling(patterns) if x[1] > 0), key=lambda x: (-x[1], -x[2], len(x[0]), x[0])):
        if not any(p.startswith(q) for q in weights if q != p):
            weights[p] = odds
    masks = [folded(e, fold) for e in GIVEN]

    def hits(t, masks):
        out = {}
        for i in (i for i, c in enumerate(t[:-1]) if c == " "):
            best = max((w for p, w in weights.items() if t.startswith(p, i)), default=0)
            if best and not any(t.startswith(m, j) for m in masks for j in range(max(0, i - len(m) + 2), i + 1)):
                out[i] = best
        return out

    def phrases(t):
        words, at = t.split(), [i for i, c in enumerate(t[:-1]) if c == " "]
        found = hits(t, masks)
        return {" ".join(words[k : k + 2]) for k in range(len(words) - 1) if at[k] in found or at[k + 1] in found}

    learned = [f" {p} " for p, odds, _ in telling(phrases, lambda t: bool(hits(t, masks))) if odds < 0]
    masks = masks + learned
    measured = [(float(sum(h.values())), len(h), len(t.split())) for t in flat for h in [hits(t, masks)]]
    seen = [(y, *(lambda t: (lambda h: (float(sum(h.values())), len(h), len(t.split())))(hits(t, masks)))(folded(x, fold))) for y in (0, 1) for x in texts[y]]
    y, *cols = (np.array(c, float) for c in zip(*seen, strict=True))
    w = calibrate(measures(*cols), y)
    z = np.c_[np.ones(len(rows)), measures(*(np.array(c, float) for c in zip(*measured, strict=True)))] @ w
    return measured, 1 / (1 + np.exp(-z)), learned


def test_toxicity_against_plain_search(spark):
    rng = random.Random(12)
    words = [f"word{i}" for i in range(60)]
    rows, labels = [], {}
    for i in range(400):
        x = rng.choices(words, k=rng.randint(3, 30))
        if i % 2 == 0:
            x += rng.choices(["gr0bble", "GROBBLER", "snurf", "trash"], k=3)
        elif i % 20 == 1:
            x[1:1] = rng.choice([["snurf", "board"], ["trash", "can"]])
        rows.append((i, " ".join(x)))
        labels[i] = int(i % 2 == 0)
    rows += [(400, None), (401, ""), (402, "snurf board snurf"), (403, "grobble " * 5000), (404, "trash, bin")]
    labels |= {401: 0, 403: 1}
    config = LexiconConfig(least_odds=2.0)
    measured, score, learned = plain_toxicity(rows, labels, config)
    assert learned == [" snurf board "]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity_scores(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"), crc_mod(5) != 0, config=config, exceptions=GIVEN).collect()}
    for (i, _), m, p in zip(rows, measured, score, strict=True):
        assert (got[i]["n_found"], got[i]["n_words"]) == m[1:] and got[i]["weight"] == pytest.approx(m[0]), i
        assert got[i]["score"] == pytest.approx(p, abs=1e-6)
    assert got[402]["n_found"] == 1 and got[404]["n_found"] == 0


def test_labels_that_differ_count_twice(spark):
    docs = spark.createDataFrame([(i, f"bad{i % 3} text" if i < 50 else "good words") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 50)) for i in range(100)] + [(1, 0), (1, 1), (None, 1), (2, 7)], "doc_id long, toxic int")
    assert toxicity_scores(docs, labels, F.lit(True)).where("score is null").count() == 0


def plain_discriminant(x, y, shrinkage=0.1, floor=1e-3):
    """Log-density differences from full covariance matrices, without factors."""
    mean, scale = x.mean(axis=0), np.sqrt(np.maximum(x.var(axis=0), 1e-8))
    z, out = (x - mean) / scale, []
    for c in (0, 1):
        own = z[y == c]
        cov = np.cov(own.T, bias=True)
        cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + floor * np.eye(len(cov))
        d = lambda a, m=own.mean(axis=0), k=cov, n=len(own): np.log(n) - 0.5 * np.linalg.slogdet(k)[1] - 0.5 * np.einsum("ij,jk,ik->i", a - m, np.linalg.inv(k), a - m)
        out.append(d)
    return lambda a: 1 / (1 + np.exp(np.clip(out[0]((a - mean) / scale) - out[1]((a - mean) / scale), -700, 700)))


def test_quality_against_plain_discriminant(spark):
    docs, labels = labelled(spark)
    rows = {r["doc_id"]: statistics((r["text"] or "").encode()) for r in docs.where("doc_id is not null").collect()}
    train = [(r["doc_id"], r["quality"]) for r in labels.collect() if r["quality"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    want = plain_discriminant(np.array([rows[i] for i, _ in train]), np.array([y for _, y in train]))(np.array(list(rows.values())))
    got = dict(quality_scores(docs, labels, crc_mod(4) != 2).select("doc_id", "score").collect())
    assert [got[i] for i in rows] == pytest.approx(want.tolist(), abs=1e-6)
    # the filter of the pipeline decides alike
    kept = {r["doc_id"] for r in accepted(docs, fit_quality(statistics_table(labelled_rows(docs, labels), crc_mod(4) != 2), labels)).collect()}
    assert kept == {i for i, s in got.items() if s >= 0.7}


# --- the pipeline ---


def test_pipeline_against_plain_steps(spark, tmp_path):
    from .test_pairs import brute_components, brute_windows

    docs, labels = labelled(spark)
    rng = random.Random(9)
    items = [(i, " ".join("".join(rng.choice("bcdfgh") for _ in range(4)) for _ in range(20))) for i in range(3)]
    clean = [r for r in docs.where("doc_id % 4 <> 0 and doc_id < 600").orderBy("doc_id").limit(60).collect()]
    extra = [(10_000 + i, r["text"] + (" " if i % 2 else ""), "s1") for i, r in enumerate(clean[:20])]
    extra += [(11_000 + i, r["text"] + " " + items[i % 3][1], "s2") for i, r in enumerate(clean[20:30])]
    all_ = docs.select("doc_id", "text", F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("source")).unionByName(spark.createDataFrame(extra, "doc_id long, text string, source string"))
    all_ = all_.where("doc_id is not null and (doc_id < 600 or doc_id >= 10000)").select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"))
    d = str(tmp_path)
    all_.coalesce(1).write.parquet(f"{d}/documents.parquet")
    labels.coalesce(1).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in now.collect()}
    scores = {r["doc_id"]: r["score"] for r in quality_scores(now, spark.read.parquet(f"{d}/labels.parquet"), crc_mod(4) != 2).collect()}
    kept = {i: t for i, t in kept.items() if scores[i] >= 0.7}
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i]), i)
    kept = {i: kept[i] for i in first.values()}
    ids = sorted(kept)
    found = brute_components([kept[i] for i in ids])
    kept = {ids[k]: kept[ids[k]] for k in range(len(ids)) if found[k][1] == k}
    ids = sorted(kept)
    kept = {i: kept[i] for i, (n, hit, _) in zip(ids, brute_windows([kept[i] for i in ids], items), strict=True) if not (hit > 0 and 20 * hit >= n)}
    result = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in result} <= set(kept) and sum(r["taken"] for r in result) == sum(len(t.split()) for t in kept.values())
    stage = now
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, d)
        assert stage.columns == now.columns
    assert {r["doc_id"] for r in stage.collect()} == set(kept)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, now.limit(0), d).count() == 0
