"""Operators on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import (
    bloom, chars, components, cross_entropy, decontaminate, language, licenses, mixing, neighbours, quality, simhash,
    totals, url_filter, warc,
)
from docloom.llm.common import word_count
from tests.llm.conftest import ODD, prose

# --- helpers ---------------------------------------------------------------------------


def test_prefix_sums(lines):
    rows = [(i * 7919 % 101, None if i % 10 == 0 else i) for i in range(500)]
    df = lines.createDataFrame(rows, "k int, v long").repartition(5)
    got = totals.sums_before(df, [F.col("k"), F.col("v")], {"before": "v"}).collect()
    seen, total = [], 0
    for k, v in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        seen.append((k, v, total))
        total += v or 0
    assert sorted(((r["k"], r["v"], r["before"]) for r in got), key=repr) == sorted(seen, key=repr)
    assert totals.sums_before(df.limit(0), [F.col("k")], {"before": "v"}).count() == 0


@pytest.mark.parametrize("most", [1, 4096])
def test_bloom_never_refuses_a_listed_key(lines, most):
    listed = lines.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    keys = lines.range(6000).select(F.concat(F.lit("k"), "id").alias("key")).unionByName(
        lines.createDataFrame([(None,)], "key string")
    )
    filter_ = bloom.build(listed, "key", max_blocks=most)
    assert filter_.blocks <= most
    got = {r["key"]: r["hit"] for r in filter_.flag(keys, F.col("key"), "hit").collect()}
    assert len(got) == 6001 and got[None] is False
    assert all(got[f"k{i}"] for i in range(2000))
    if most > 1:
        assert sum(got[f"k{i}"] for i in range(2000, 6000)) < 100
    none = bloom.build(listed.limit(0), "key").flag(keys, F.col("key"), "hit")
    assert none.where("hit").count() == 0


def test_components_of_chains_stars_and_loops(lines):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components.components(lines.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components.components(lines.createDataFrame([], "a long, b long")).count() == 0


def test_tokens_split_and_ignore_case(monkeypatch):
    text = "Größe 12a, naïve—ÉTÉ don't 東京 x"
    codes = chars.code_points(text)
    t = chars.tokens(codes)
    assert [text[a:b] for a, b in zip(t.start, t.end, strict=True)] == ["Größe", "12a", "naïve", "ÉTÉ", "don", "t", "東京", "x"]
    assert (chars.tokens(chars.code_points(text.lower())).hash == t.hash).all()
    assert len(chars.tokens(codes, symbols=True).hash) == len(t.hash) + 3
    monkeypatch.setattr(chars, "SEGMENT", 12)
    assert (chars.tokens(codes).hash == t.hash).all()


# --- 1 SimHash -------------------------------------------------------------------------


def test_links_by_index_equal_all_pairs():
    random = np.random.default_rng(3)
    centres = random.integers(0, 2**63, 4, dtype=np.uint64)
    codes = [c ^ np.bitwise_or.reduce(np.uint64(1) << random.integers(0, 64, n).astype(np.uint64)) for c in centres for n in random.integers(1, 5, 200)]
    codes = np.unique(np.array([*codes, *random.integers(0, 2**63, 200, dtype=np.uint64)]))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    a, b = simhash.links_of(codes)
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= simhash.RADIUS
    assert {(int(x), int(y)) for x, y in zip(a, b, strict=True)} == {(int(x), int(y)) for x, y in zip(*np.nonzero(np.triu(near, 1)), strict=True)}


@pytest.mark.parametrize("part_rows", [1024, 16])
def test_parts_that_are_dealt_again_lose_no_component(lines, monkeypatch, part_rows):
    monkeypatch.setattr(simhash, "PART_ROWS", part_rows)
    random = np.random.default_rng(5)
    base = int(random.integers(0, 2**62))
    codes = {base ^ sum(1 << int(b) for b in random.choice(64, n, replace=False)) for n in random.integers(0, 5, 600)}
    signed = np.array(sorted(codes), np.uint64).view(np.int64)
    df = lines.createDataFrame([(int(c),) for c in signed], "print long")
    got = {r["node"]: r["root"] for r in components.components(simhash.near_links(df)).collect()}
    values = np.sort(signed)
    near = np.bitwise_count(values.view(np.uint64)[:, None] ^ values.view(np.uint64)[None]) <= simhash.RADIUS
    label = np.arange(len(values))
    while True:
        least = np.where(near, label[None], len(label)).min(axis=1)
        if (least == label).all():
            break
        label = least
    assert {int(v): got.get(int(v), int(v)) for v in values} == {int(v): int(values[m]) for v, m in zip(values, label, strict=True)}


def test_simhash_of_odd_documents(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    assert by[1] == by[3] and {c for _, c in by[1]} == {1}
    assert len(by[2]) == 1
    # Null, empty and blank texts share fingerprint zero; one null id is with them.
    assert by[4] == by[5] == by[6] == {("0" * 16, 4)}
    assert ("0" * 16, 4) in by[None] and len(by[None]) == 2
    assert simhash.near_duplicates(empty).count() == 0


def test_one_of_each_component_stays(odd, empty):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 4, 7, 8, 9, 10, 11] and ids.count(None) == 1
    assert simhash.keep_one(empty).count() == 0
    assert simhash.keep_one(odd.where("doc_id in (1, 3)")).count() == 1


# --- 2 URLs ----------------------------------------------------------------------------


def test_url_verdicts(lines):
    urls = [
        "http://A.Example.NET/en/x?y#z", "https://b.net", "https://b.net/", "x.org/fr/", "http://org/fr/1", "http://forg/fr/1",
        "http://bad.test/p/?utm_source=1&a=2#f", "https://BAD.test/p?a=2", "http://bad.test/p?a=3", None, "", "http://a.net/en/",
        "http://bad.test/q", "http://bad.test/q",
    ]
    pages = lines.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    listed = lines.createDataFrame([("http://bad.test/p?a=2",), ("https://bad.test/q/",), (None,), ("junk",)], "url string")
    rules = [url_filter.parse_rule(r) for r in ("block net/", "allow example.net/en/", "allow org/fr/")]
    got = {r["page_id"]: r for r in url_filter.judge(pages, listed, rules).collect()}
    assert [got[i]["verdict"] for i in range(len(urls))] == [
        "allow", "allow", "block", "allow", "allow", "allow", "block", "block", "allow", "allow", "allow", "block", "block", "block",
    ]
    assert [got[i]["rule"] for i in (0, 1, 2, 4, 11)] == ["example.net/en/", None, "net/", "org/fr/", "net/"]
    assert (got[0]["host"], got[0]["path"], got[9]["host"], got[10]["path"]) == ("a.example.net", "/en/x", "", "")
    assert url_filter.judge(pages.limit(0), listed, rules).count() == 0
    assert url_filter.judge(pages, listed.limit(0), []).where("verdict = 'block'").count() == 0


# --- 3 cross-entropy -------------------------------------------------------------------


def test_cross_entropy_of_odd_documents(lines, odd, empty):
    labels = lines.createDataFrame([(1, 1, 0), (1, 1, None), (2, 1, 1), (7, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    target = cross_entropy.good_ids(labels)
    assert [r["doc_id"] for r in target.collect()] == [1]
    models = cross_entropy.fit(odd, target)
    rows = cross_entropy.score(odd, models).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[4]["tokens"] == by[5]["tokens"] == by[6]["tokens"] == 1 and by[4]["score"] == by[5]["score"]
    assert all(math.isfinite(r["score"]) for r in rows)
    assert by[1]["score"] < by[10]["score"]
    # Losses are those of a model of probabilities.
    assert np.allclose(np.exp(-cross_entropy.losses(np.random.default_rng(1).random((64, 64)) * 9)).sum(axis=1), 1, atol=1e-4)
    assert cross_entropy.score(empty, models).count() == 0
    for docs, ids in ((odd, target.limit(0)), (empty, target)):
        flat = cross_entropy.fit(docs, ids)
        assert (flat.target == flat.background).all()
    assert all(r["score"] == 0 for r in cross_entropy.score(odd, flat).collect())


def plain_scores(docs: list[str], target: list[int]) -> list[float]:
    """Scores of all documents by counts in dictionaries."""
    words = [["<>", *text.split(), "<>"] for text in docs]
    pairs = [Counter(zip(w, w[1:], strict=False)) for w in words]
    all_, good = sum(pairs, Counter()), sum((pairs[i] for i in target), Counter())
    kinds, scale = len({b for _, b in all_}) + 1, sum(good.values()) / sum(all_.values())

    def mean(counts: Counter, scale: float, i: int) -> float:
        total, before, word = sum(counts.values()) * scale, Counter(), Counter()
        for (a, b), n in counts.items():
            before[a] += n * scale
            word[b] += n * scale
        chances = [
            (counts[a, b] * scale + 50 * (word[b] + 1) / (total + kinds)) / (before[a] + 50) for a, b in pairs[i].elements()
        ]
        return -sum(map(math.log, chances)) / len(chances)

    return [mean(good, 1.0, i) - mean(all_, scale, i) for i in range(len(docs))]


@pytest.mark.parametrize("head", [0, 100, 1 << 18])
def test_cross_entropy_counts_every_word(lines, monkeypatch, head):
    """Over 1024 words are common; texts that differ in rarer words alone must still differ."""
    monkeypatch.setattr(cross_entropy, "HEAD", head)
    common = " ".join(f"w{i}" for i in range(1200))
    rare = ["amber birch", "amber birch", "cobalt delta", "cobalt delta", "echo", ""]
    texts = [f"{common} {common} {r}".strip() for r in rare] + ["", "amber birch amber birch"]
    docs = lines.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    models = cross_entropy.fit(docs, docs.where("doc_id in (0, 4)").select("doc_id"))
    got = {r["doc_id"]: r["score"] for r in cross_entropy.score(docs, models).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], plain_scores(texts, [0, 4]))
    assert got[1] < got[2] - 1e-6
    # Texts that are not among those of the models.
    other = lines.createDataFrame([(1, "amber birch"), (2, "never seen"), (None, "cobalt delta")], "doc_id long, text string")
    by = {r["doc_id"]: r["score"] for r in cross_entropy.score(other, models).collect()}
    assert len(by) == 3 and by[1] < by[None] and all(map(math.isfinite, by.values()))


@pytest.mark.parametrize("head", [0, 1 << 18])
def test_cross_entropy_of_null_texts_without_empty_ones(lines, monkeypatch, head):
    monkeypatch.setattr(cross_entropy, "HEAD", head)
    docs = lines.createDataFrame([(1, "amber birch"), (2, "cobalt"), (3, None)], "doc_id long, text string")
    models = cross_entropy.fit(docs, docs.where("doc_id = 1").select("doc_id"))
    by = {r["doc_id"]: r for r in cross_entropy.score(docs, models).collect()}
    assert by[3]["tokens"] == 1 and by[3]["target_loss"] == by[3]["background_loss"] == by[3]["score"] == 0
    assert by[1]["score"] < 0 < by[2]["score"]


@pytest.mark.parametrize("head", [0, 100, 1 << 18])
def test_cross_entropy_stores_words_and_frequent_pairs_only(lines, monkeypatch, head):
    """Texts whose pairs are nearly all different: their pairs are counted where they meet, in batches of few rows."""
    random_ = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(random_.choices(words, k=120)) for _ in range(60)]
    docs = lines.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    stored, store = [], cross_entropy._stored

    def counted(df):
        stored.append(store(df))
        return stored[-1]

    monkeypatch.setattr(cross_entropy, "_stored", counted)
    monkeypatch.setattr(cross_entropy, "HEAD", head)
    monkeypatch.setattr(cross_entropy, "FIRST", 20, raising=False)
    monkeypatch.setattr(cross_entropy, "HELD", 500)
    models = cross_entropy.fit(docs, docs.where("doc_id < 9").select("doc_id"))
    got = {r["doc_id"]: r["score"] for r in cross_entropy.score(docs, models).collect()}
    assert np.allclose([got[i] for i in range(60)], plain_scores(texts, list(range(9))))
    assert max(df.count() for df in stored) <= 20 * 20


def test_cross_entropy_weighs_few_pairs_at_once(lines, monkeypatch):
    """However many pairs a task gets, those of a bucket are weighed in small shares, and no pair is a row of its own."""
    random_ = random.Random(6)
    texts = [" ".join(random_.choices([f"w{i}" for i in range(200)], k=150)) for _ in range(40)]
    docs = lines.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    most = lines.sparkContext.accumulator(0)
    weighed = cross_entropy._weighed

    def counted(key, *others):
        # Only a key with more pairs makes a larger share.
        assert len(key) <= 400, len(key)
        most.add(1)
        return weighed(key, *others)

    for name, value in (("HEAD", 50), ("FIRST", 10), ("WEIGHED", 100), ("HELD", 300), ("_weighed", counted)):
        monkeypatch.setattr(cross_entropy, name, value, raising=False)
    scored = cross_entropy.score(docs, cross_entropy.fit(docs, docs.where("doc_id < 9").select("doc_id")))
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert np.allclose([got[i] for i in range(40)], plain_scores(texts, list(range(9))))
    assert most.value > 20


def test_cross_entropy_leaves_texts_of_many_good_ids_in_place(lines):
    """Ids too many to broadcast meet ids, not texts; those that the filter takes for others are told apart."""
    docs = lines.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    ids = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("_target"))
    before = lines.conf.get("spark.sql.autoBroadcastJoinThreshold")
    lines.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    try:
        flagged = cross_entropy._flagged(docs, ids)
        assert "SortMergeJoin" not in flagged._jdf.queryExecution().executedPlan().toString()
        assert {int(r["name"]): r["good"] for r in flagged.collect()} == {i: i % 2 == 0 for i in range(4000)}
    finally:
        lines.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# --- 4 mixing --------------------------------------------------------------------------


def plain_targets(sizes: list[int], weights=(3, 1, 2), share=1.5, most=2.0) -> list[float]:
    """Reshare the excess by weight until no source is above its limit."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        level = left / sum(weight[i] for i in open_)
        above = {i for i in open_ if level * weight[i] > most * sizes[i]}
        if not above:
            for i in open_:
                target[i] = level * weight[i]
            break
        for i in above:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ -= above
    return target


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 3, 50, 0, 7, 7], [5], [0, 0], [900, 1, 1, 1, 1, 1]])
def test_targets_equal_resharing(lines, sizes):
    sources = lines.createDataFrame([(f"s{i:02d}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sources).collect()}
    assert np.allclose([got[f"s{i:02d}"] for i in range(len(sizes))], plain_targets(sizes))


def test_mix_of_odd_documents(odd, empty):
    sized = odd.select("doc_id", "source", word_count(F.col("text")).alias("size"), mixing.prose_weight(F.col("text")).alias("weight"), F.lit(1).alias("taken"))
    rows = mixing.mix(sized).collect()
    assert len(rows) == len(ODD)
    names = {(r[0], r[3]) for r in ODD}
    assert len({r["source_size"] for r in rows if r["doc_id"] in (1, 2)}) == 1 and len(names) > 1
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    taken = {}
    for r in rows:
        key = (r["source_size"], r["target"])
        taken[key] = taken.get(key, 0) + r["taken"]
    assert all(n == math.floor(target) for (_, target), n in taken.items())
    again = mixing.mix(sized.repartition(7)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert mixing.mix(empty.select("doc_id", "source", F.lit(1).alias("size"), F.lit(1.0).alias("weight"))).count() == 0


def test_junk_is_drawn_less(lines):
    docs = lines.createDataFrame([(i, "s", 10, 1.0 if i % 2 else 0.05) for i in range(400)], "doc_id long, source string, size long, weight double")
    rows = mixing.mix(docs).collect()
    # 150% of one source: one epoch and half of it.
    assert sum(r["taken"] for r in rows) == 6000
    assert sum(r["taken"] > 10 for r in rows if r["doc_id"] % 2) > 3 * sum(r["taken"] > 10 for r in rows if not r["doc_id"] % 2)


# --- 5 neighbours ----------------------------------------------------------------------


def test_probing_finds_every_code_in_the_radius():
    random = np.random.default_rng(2)
    codes = random.integers(0, 1 << 16, (3000, 3)).astype(np.uint16)
    codes[:500] = codes[0] ^ (random.integers(0, 16, (500, 3)) == 0).astype(np.uint16)
    index = neighbours.Index(codes)
    for query in (codes[0], codes[999], np.zeros(3, np.uint16)):
        far = np.bitwise_count(codes ^ query).sum(axis=1)
        for enough in (1, 20, 700, 5000):
            got = index.within(query, enough)
            assert len(got) >= min(enough, len(codes))
            assert set(got) == set(np.flatnonzero(far <= far[got].max()))


def test_neighbours_of_odd_vectors(lines, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(1, 60)]
    rows += [(0, [1.0, 1.0, 1.0]), (0, [1.0, 1.0, 1.0]), (0, [5.0, 4.0, 1.0]), (100, None), (101, []), (102, [0.0, 0.0, 0.0])]
    rows += [(103, [nan, 1.0, 1.0]), (104, [inf, 1.0, 1.0]), (105, [None, 1.0, 1.0]), (106, [1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    df = lines.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    sound = [(i, np.array(v)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows[:62])]
    for block in (16384, 20):
        monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
        monkeypatch.setattr(neighbours, "QUERY_ROWS", 2)
        got = neighbours.search(df, df.where("vec_id % 20 = 0")).collect()
        answers = {}
        for r in sorted(got, key=lambda r: r["rank"]):
            answers.setdefault(r["query_id"], []).append((round(r["score"], 9), r["vec_id"]))
        assert set(answers) == {0, 20, 40}
        for i in (20, 40):
            q = dict(sound)[i]
            best = sorted((round(float(np.sqrt(((v - q) ** 2).sum())), 9), j) for j, v in sound if j != i)[:10]
            assert answers[i] == best
        assert len(answers[0]) == 20 and 0 not in {j for _, j in answers[0]}
    assert len(neighbours.search(df.where("vec_id in (1, 2, 20)"), df.where("vec_id = 20")).collect()) == 2
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0
    assert neighbours.search(df, df.limit(0)).count() == 0


# --- 6 decontamination -----------------------------------------------------------------

QUESTION = "A trader named Alice buys 12 apples and 7 pears for 30 dollars. How many pears does Alice sell if 7 pears weigh 2 kg?"


def held(lines, texts, items):
    docs = lines.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit(1))
    bench = lines.createDataFrame(items, "item_id long, text string").withColumn("at", F.lit(1))
    return {(r["doc_id"], r["item_id"]): r["same_slots"] for r in decontaminate.matches(docs, bench).collect()}


def test_reparameterised_questions_are_found_if_slots_agree(lines):
    other = QUESTION.replace("Alice", "Maria").replace("12", "55").replace("7", "9").replace("30 dollars", "80 euros")
    broken = QUESTION.replace("named Alice", "named Maria").replace("7 pears for", "9 pears for")
    texts = [f"{prose(1)} {QUESTION} {prose(2)}", f"{prose(3)}\n{other}", broken, prose(4), None, "", QUESTION.upper()]
    got = held(lines, texts, [(5, QUESTION), (6, None), (7, "too short"), (8, ""), (None, prose(4))])
    assert got == {(0, 5): True, (1, 5): False, (6, 5): True}


def test_items_of_few_tokens_are_found_as_they_stand(lines):
    texts = ["We saw Silver OTTERS, dance there.", "silver otters sing", "otters dance", "Silver 12 otters dance", "x 42 y", "x 43 y"]
    got = held(lines, texts, [(1, "silver otters dance"), (2, "Otters dance"), (3, "42"), (4, "?!")])
    assert set(got) == {(0, 1), (0, 2), (2, 2), (3, 2), (4, 3)}


def test_short_items_and_passages(lines):
    short = "silver otters dance quietly tonight"
    got = held(lines, [f"{prose(1)} {short} {prose(2)}", prose(1), " ".join(prose(9).split()[10:30])], [(1, short), (2, prose(9))])
    assert got == {(0, 1): True, (2, 2): True}
    assert held(lines, [prose(1)], []) == {} and held(lines, [], [(1, prose(1))]) == {}


def test_one_changed_value_does_not_hide_a_line(lines):
    altered = QUESTION.replace("7 pears for", "9 pears for")
    roles = "A box holds 2 red marbles of glass. Later the owner adds 2 blue marbles that were found under the table by the window."
    texts = [altered, roles.replace("2 red", "3 red").replace("2 blue", "5 blue"), QUESTION.replace("Alice sell", "Maria sell")]
    assert held(lines, texts, [(5, QUESTION), (6, roles)]) == {(0, 5): False, (1, 6): False, (2, 5): False}


def test_words_are_paired_by_place(lines):
    """A first word that is a name only in the document does not shift the values behind it."""
    item = "Prices 10 20 30 40 50 60 70 80 90 100 110 120 130 140"
    assert held(lines, [f"they list the {item}"], [(1, item)]) == {(0, 1): True}


def test_numbers_alone_are_compared_word_by_word(lines):
    got = held(lines, ["1 2 3 4 5 6 7 8 9 10", "11 12 13 14 15 16 17 18 19 20"], [(1, "1 2 3 4 5 6 7 8 9 10")])
    assert got == {(0, 1): True}


# --- 7 language ------------------------------------------------------------------------


def test_best_path_equals_enumeration():
    from itertools import product

    random = np.random.default_rng(4)
    for spread in (0.5, 6, 20):
        scores = random.normal(0, spread, (7, 3)).astype(np.float32)
        value = lambda p, s=scores: sum(s[t, k] for t, k in enumerate(p)) - language.SWITCH * sum(a != b for a, b in zip(p, p[1:], strict=False))
        best = max(value(p) for p in product(range(3), repeat=7))
        assert value(language.best_path(scores)) == pytest.approx(best, abs=1e-4)


def test_spans_of_mixed_and_odd_texts(lines, odd, empty):
    german = "der die und nicht eine schöne straße über das haus gehen wir heute abend spazieren"
    rows = [("en", prose(i)) for i in range(20)] + [("de", german)] * 3 + [("ru", "Привет мир как дела сегодня")] * 3 + [(None, "x"), ("en", None)]
    model = language.learn(lines.createDataFrame(rows, "lang string, text string"))
    mixed = f"{prose(77)} {german} {prose(78)}"
    assert [s[2] for s in model.spans(mixed)] == ["en", "de", "en"]
    a, b = model.spans(mixed)[1][:2]
    assert mixed[a:b] == german
    got = language.identify(odd, model).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1, 4, 5, 6, 7, 9, 10)] == ["en", "und", "und", "und", "und", "en", "ru"]
    assert all(0 <= r["score"] <= 1 for r in got) and by[5]["spans"] == []
    assert language.identify(empty, model).count() == 0
    assert model.predict("\u0301 1 \u0308")[0] == model.predict("١٢")[0] == "und"
    none = language.learn(empty)
    assert {r["lang_pred"] for r in language.identify(odd, none).collect()} == {"und"}


# --- 8 WARC ----------------------------------------------------------------------------


def test_archives_round_trip(lines, monkeypatch):
    big = "é" * 3_000_000
    html = {1: "a" * 120, 2: "b" * 99, 3: "b" * 99, 4: "a" * 120, 5: None, 6: "", 7: big, 8: "a" * 120}
    rows = [(i, f"http://h/{i}\r\nX: %41", t, 9) for i, t in html.items()] + [(1, None, "a" * 120, 9), (None, "u", "c" * 100, 9), (None, "u", "a" * 120, 9)]
    pages = lines.createDataFrame(rows, "page_id long, url string, html string, offset int").repartition(3)
    monkeypatch.setattr(warc, "FILE_BYTES", 300)
    folder = warc.new_folder(lines)
    index = warc.write_archives(pages, folder)
    assert index.count() == len(rows) and index.select("file").distinct().count() > 3
    got = warc.read_records(index, folder).collect()
    assert len(got) == len(rows)
    kinds = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got), key=repr)
    wanted = [(i, "response", None) for i in (1, 1, 2, 3, 5, 6, 7, None)] + [(4, "revisit", 1), (8, "revisit", 1), (None, "revisit", 1)]
    assert kinds == sorted(wanted, key=repr)
    for r in got:
        text = (html.get(r["page_id"]) or "") if r["page_id"] else None
        if r["page_id"]:
            assert r["payload_bytes"] == len(text.encode())
            if r["record_type"] == "response":
                assert bytes(r["payload"]).decode() == text
    assert {r["url"] for r in got} == {r[1] for r in rows}
    some = warc.read_records(index.where("page_id in (3, 7)"), folder, payloads=False).collect()
    assert {r["page_id"] for r in some} == {3, 7} and all(r["payload"] is None for r in some)
    assert warc.digests(pages.limit(0), warc.new_folder(lines)).count() == 0


# --- 9 licences ------------------------------------------------------------------------


def test_licences_are_confirmed_by_templates(lines, odd, empty):
    texts = [
        f"{prose(1)}\nReleased under the MIT License.\n\n{prose(2)}", "Licensed under the Apache License, Version 1.1.",
        "You need a driving licence.\nThe rights of all.", None, "", "SPDX-License-Identifier: MPL-2.0",
    ]
    docs = lines.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, family int")
    model = licenses.fit(docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")))
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in licenses.scan(docs, model).collect()}
    assert got == {(0, 2): "mit", (1, 1): "apache", (2, 1): "unknown", (2, 2): "unknown", (5, 1): "mpl"}
    assert licenses.scan(empty, model).count() == 0
    assert licenses.scan(odd, model).count() == 0
    bare = licenses.fit(empty)
    assert {r["family"] for r in licenses.scan(docs.where("doc_id = 0"), bare).collect()} == {"mit"}


def test_every_family_over_the_threshold_has_a_row(lines):
    """Against all templates on every line: no cue, none of the classifier's doubts hides a match."""
    texts = [t for ts in licenses.TEMPLATES.values() for t in ts]
    cut = [" ".join(t.split()[i:j]) for t in texts for i, j in ((1, None), (2, None), (0, -1), (0, -2), (1, -1))]
    whole = [f"{prose(i)} {t.upper()} {prose(i + 50)}" for i, t in enumerate(texts)]
    rows = list(enumerate([*texts, *cut, *whole, *(t.replace(" ", "-").replace("2", "x2") for t in texts), prose(7)]))
    docs = lines.createDataFrame(rows, "doc_id long, text string")
    model = licenses.fit(docs.where("doc_id < 0"))
    got = licenses.scan(docs, model).collect()
    expected = set()
    for i, text in rows:
        shingles = set(licenses._template_shingles(text))
        for family, wanted in licenses.TEMPLATES.items():
            parts = [set(licenses._template_shingles(t)) for t in wanted]
            if max(len(p & shingles) / len(p) for p in parts) >= licenses.CONFIRMED:
                expected.add((i, family))
    assert {(r["doc_id"], r["family"]) for r in got if r["family"] != "unknown"} == expected
    assert len(got) == len({(r["doc_id"], r["family"]) for r in got})
    assert all(0 <= r["probability"] <= 1 and 0 <= r["similarity"] <= 1 for r in got)
    granted = texts.index(licenses.TEMPLATES["mit"][1]) * 5 + len(texts)
    assert (granted, "mit") in expected and not rows[granted][1].startswith("Permission")


def test_terms_of_creative_commons_are_one_word(lines):
    texts = {
        "Licensed under CC BY-NC 4.0.": {"cc-by-nc"}, "Licensed under CC-BY-NC 4.0.": {"cc-by-nc"},
        "Licensed under CC BY-SA 4.0.": {"cc-by-sa"}, "Licensed under CC BY 4.0.": {"cc-by"},
        "Released under CC-BY 4.0.": {"cc-by"}, "Licensed-under-CC-BY-NC-4.0.": {"cc-by-nc"},
    }
    docs = lines.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["doc_id"], r["family"]) for r in licenses.scan(docs, licenses.fit(docs)).collect()}
    assert found == {(i, family) for i, families in enumerate(texts.values()) for family in families}


def test_notices_over_several_lines_are_found(lines):
    """Against all templates on all runs of lines of a paragraph; a run counts if no run within it does the same."""
    texts = [t for ts in licenses.TEMPLATES.values() for t in ts]
    choose, docs = random.Random(9), []
    for text in texts:
        words = text.split()
        cuts = sorted(choose.sample(range(len(words) + 1), 2))
        halves = [" ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])]
        thirds = [" ".join(words[: cuts[0]]) + " --", " ".join(words[cuts[0] : cuts[1]]) + " --", " ".join(words[cuts[1] :]) + " --"]
        docs += ["\n".join(halves), "\r\n".join(f"// {t}" for t in thirds), "\n \n".join(halves), "\n----\n".join(halves)]
        docs.append("\n".join([prose(3), *halves, text, *halves, prose(4), "", *thirds]))
    for _ in range(60):  # shuffled pieces of the templates of two families
        pieces = []
        for text in choose.sample([t for f in choose.sample(sorted(licenses.TEMPLATES), 2) for t in licenses.TEMPLATES[f]] * 3, 4):
            words, at = text.split(), 0
            while at < len(words):
                size = choose.randint(1, 5)
                pieces.append(" ".join(words[at : at + size]))
                at += size - choose.randint(0, 1) * (size > 1)
        if choose.random() < 0.5:
            pieces[choose.randrange(len(pieces))] = choose.choice(["", "\t", "...", "Привет"])
        docs.append("\n".join(pieces))
    docs += [docs[0]]
    # Shingles that are next to prose with the rest of them are no notice.
    docs.append("\n".join(["208.98.142.209 " + prose(6), "This work is licensed under the GNU General Public License, version 3."]))
    shingles = {
        f: [(set(licenses._template_shingles(t)), int(licenses.SPREAD * len(licenses._template_words(t)))) for t in ts]
        for f, ts in licenses.TEMPLATES.items()
    }
    expected, covered = [], set()
    for n, text in enumerate(docs):
        rows = text.split("\n")
        held = {}
        for i in reversed(range(len(rows))):
            for j in range(i, len(rows)):
                if not rows[j].strip():
                    break
                words, held[i, j] = licenses._template_words(" ".join(rows[i : j + 1])), set()
                for f, parts in shingles.items():
                    for part, long in parts:
                        long = long if j > i else len(words)
                        near = [{" ".join(words[k : k + 2]) for k in range(s, min(s + long, len(words)) - 1)} for s in range(len(words))]
                        if any(len(part & has) / len(part) >= licenses.CONFIRMED for has in near):
                            held[i, j].add(f)
                held[i, j] |= {f for k in range(i, j + 1) for f in held[k, k]}
        for (i, j), families in held.items():
            for f in families - held.get((i + 1, j), set()) - (held[i, j - 1] if j > i else set()):
                expected.append((n, i + 1, f))
                covered |= {(n, k + 1) for k in range(i, j + 1) if j > i}
    table = lines.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = licenses.scan(table, licenses.fit(table.where("doc_id < 0"))).collect()
    assert sorted((r["doc_id"], r["paragraph"], r["family"]) for r in got if r["family"] != "unknown") == sorted(expected)
    assert all(r["similarity"] >= licenses.CONFIRMED for r in got if r["family"] != "unknown")
    assert not covered & {(r["doc_id"], r["paragraph"]) for r in got if r["family"] == "unknown"}
    assert all(0 <= r["probability"] <= 1 for r in got) and len(covered) > 2 * len(texts)
    assert [(i, f) for n, i, f in expected if n == len(docs) - 1] == [(2, "gpl")]


def test_lines_without_a_cue_word_are_classified(lines):
    rows = [(0, "Distributed under the GNU Affero General Public terms, version 3."), (1, prose(5)), (2, "A general is in public.")]
    docs = lines.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan(docs, licenses.fit(docs)).collect()
    assert [(r["doc_id"], r["paragraph"], r["family"]) for r in got] == [(0, 1, "unknown")]
    assert 0.5 <= got[0]["probability"] <= 1 and 0 < got[0]["similarity"] < licenses.CONFIRMED


# --- 10 quality ------------------------------------------------------------------------


def test_quality_of_odd_documents(lines, odd, empty):
    junk = [" ".join(f"{w}{'#$%&'[i % 4] * 3}" for w in prose(i).split()) for i in range(40)]
    docs = [(i, prose(i), 1) for i in range(40)] + [(100 + i, t, 0) for i, t in enumerate(junk)]
    table = lines.createDataFrame(docs, "doc_id long, text string, quality int")
    labels = table.select("doc_id", "quality").unionByName(lines.createDataFrame([(1, None), (2, 7), (None, 1)], "doc_id long, quality int"))
    model = quality.fit_labelled(table, labels)
    scores = {r["doc_id"]: r["s"] for r in odd.select("doc_id", model.text_column(F.col("text")).alias("s")).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[1] > 0.5
    assert scores[4] == scores[5]
    fresh = [prose(500), " ".join(w + "***" for w in prose(501).split())]
    good, bad = model.scores(np.stack([quality.statistics(t) for t in fresh]))
    assert good > 0.5 > bad
    vectors = table.select("doc_id", quality.statistics_column(F.col("text")).alias("vector"))
    same = quality.fit_on(vectors, labels, F.lit(True))
    assert np.allclose(same.means, model.means) and np.allclose(same.factors, model.factors)
    one = quality.fit_labelled(table, labels.where("quality = 1"))
    assert one.scores(np.zeros((2, len(quality.STATISTICS)))).tolist() == [1.0, 1.0]
    none = quality.fit_labelled(empty, labels.limit(0))
    assert none.scores(np.zeros((1, len(quality.STATISTICS)))).tolist() == [0.5]
    assert empty.select(model.text_column(F.col("text"))).count() == 0


def test_discriminant_equals_densities():
    random = np.random.default_rng(8)
    factors = np.array([np.linalg.inv(np.linalg.cholesky(np.eye(3) * v)) for v in (1.0, 4.0)])
    model = quality.Discriminant(0.5, np.zeros((2, 3)), factors, np.array([0.0, -1.5 * np.log(4.0)]))
    x = random.normal(size=(5, 3))
    density = lambda v: -0.5 * (x**2).sum(axis=1) / v - 1.5 * np.log(v)
    odds = (density(4.0) - density(1.0)) / quality.TEMPERATURE
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-odds)))
