"""Matching, percentiles, packing, leaks and reading levels: against brute force, round trips and held-out labels."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from genoquery.llm import leaks, matching, packing, quantiles, queries, reading
from tests.conftest import DATA, agrees


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    agrees(spark, duck, queries, name)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert df.columns and df.count() >= 0


# --- percentiles


def test_summary_bounds_hold():
    rng = np.random.default_rng(1)
    every, merged = [], None
    for n, kind in ((5000, "normal"), (1, "one"), (7000, "ties"), (3000, "wide")):
        x = {"normal": rng.normal(size=n), "one": np.array([3.0]), "ties": rng.integers(0, 5, n).astype(float), "wide": rng.exponential(1000, n)}[kind]
        every.append(x)
        s = quantiles.Summary.of(x).compress(0.01)
        merged = s if merged is None else merged.merge(s).compress(0.01)
    x = np.sort(np.concatenate(every))
    assert merged.n == len(x) and merged.rank_error() <= 0.011 * len(x) + 1 and len(merged.value) < 600
    lt, le = np.searchsorted(x, merged.value), np.searchsorted(x, merged.value, side="right")
    assert (merged.lt_lo <= lt).all() and (lt <= merged.lt_hi).all() and (merged.le_lo <= le).all() and (le <= merged.le_hi).all()
    for p in (1, 25, 50, 95, 99, 100):
        r = max(1, int(np.ceil(p * len(x) / 100)))
        v, off = merged.at_rank(r)
        lo, hi = np.searchsorted(x, v) + 1, np.searchsorted(x, v, side="right")
        assert max(lo - r, r - hi, 0) <= off


def test_percentiles_of_parts_and_days(spark):
    random.seed(2)
    rows = [("h" if random.random() < 0.6 else None, "m", random.choice([None, float("nan"), float(random.randrange(1000))])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, measure string, v double").repartition(5)
    both = quantiles.combine(quantiles.summarise(df.where("k is null"), ["k"], "measure", "v").unionByName(quantiles.summarise(df.where("k is not null"), ["k"], "measure", "v")), ["k", "measure"])
    got = {(r["k"], r["pct"]): (r["value"], r["rank_error"]) for r in quantiles.percentiles(both, ["k", "measure"], [50, 95]).collect()}
    for k in ("h", None):
        x = sorted(v for q, _, v in rows if q == k and v is not None and v == v)
        for p in (50, 95):
            value, off = got[k, float(p)]
            assert off == 0 and value == x[-(-p * len(x) // 100) - 1]
    assert quantiles.summarise(df.limit(0), ["k"], "measure", "v").count() == 0


# --- packing


def _check_pack(rows, docs, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {d for d, _ in docs}
    places = {}
    for d, rs in by.items():
        assert sorted(r["piece"] for r in rs) == list(range(len(rs)))
        assert len(rs) == 1 or sum(r["n_tokens"] for r in rs) > capacity
        for r in rs:
            if r["n_tokens"]:
                places.setdefault(r["container_id"], []).append((r["start"], r["start"] + r["n_tokens"]))
            else:
                assert r["container_id"] is None
    for spans in places.values():
        spans.sort()
        assert spans[-1][1] <= capacity and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    return places


def test_packing_places_every_text_once(spark):
    random.seed(4)
    docs = [(i, " ".join(["word"] * random.choice([0, 1, 5, 9, 30, 70, 130, 50]))) for i in range(700)] + [(9999, None), (9998, "word " * 700)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("piece", F.lit("clash"))
    rows = packing.pack(df, capacity=128).collect()
    places = _check_pack(rows, docs, 128)
    total = sum(b - a for s in places.values() for a, b in s)
    assert len(places) <= 1.03 * total / 128 + 2
    assert packing.pack(df.limit(0)).count() == 0


def test_plan_uses_every_length_exactly():
    rng = np.random.default_rng(5)
    counts = np.zeros(4097, np.int64)
    np.add.at(counts, np.minimum(4096, rng.lognormal(5.3, 0.9, 30_000).astype(int) + 1), 1)
    used = np.zeros(4097, np.int64)
    containers = 0
    for pattern, reps in packing.make_plan(counts):
        assert pattern.sum() <= 4096
        np.add.at(used, pattern, reps)
        containers += reps
    assert (used == counts).all()
    assert containers <= 1.01 * (counts * np.arange(4097)).sum() / 4096 + 1


# --- leaks

ITEMS = [(1, "Ledger QX-1177 credits Corvin with 503 loci on the olive arm. Mirror DW-98 in Sundrey dropped 73 packets at noon. Read the case and choose the one correct option."), (2, "Ledger ZZ-4410 credits Maravel with 88 loci on the teal arm. Donor RF-79 moved from Mosswick with 541 letters. Read the case and choose the one correct option."), (3, "Read the case and choose the one correct option. Pedigree KL-3 was redrawn because Elowen was 389 years older than thought."), (4, None), (5, "")]


def test_leaks(spark):
    one = ITEMS[0][1]
    docs = [
        (1, "Intro here. " + one + " Outro."), (2, one.upper().replace("-", "–").replace("A", "А")), (3, "x\n".join(one.split(" ")).replace("x\n", "\n")), (4, "Ledger QX-1177 credits Corvin with 503 loci on the olive arm. And more of something else entirely."),
        (5, "Ledger AB-1 credits Galia with 5 loci on the ivory arm. Read the case and choose the one correct option."), (6, "Read the case and choose the one correct option."), (7, None), (8, ""), (9, "<b>Mirror</b> DW-98 in Sundrey dropped 73 packets at noon. Then nothing"), (10, "Intro here. " + one + " Outro."),
        (11, ("long filler text " * 50_000) + one), (12, one.replace("credits", "").replace("dropped", "lost")),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(77))
    got = {(r["doc_id"], r["item_id"]): r for r in leaks.find(df, ITEMS).collect()}
    assert {k for k in got} >= {(1, 1), (2, 1), (3, 1), (10, 1), (11, 1), (12, 1)}
    assert not {k for k in got if k[0] in (5, 6, 7, 8)}
    r = got[1, 1]
    assert docs[0][1][r["first_char"] : r["last_char"] + 1].startswith("Ledger QX-1177")
    assert leaks.find(df, []).count() == 0 and leaks.find(df.limit(0), ITEMS).count() == 0


def test_equal_and_overlapping_items(spark):
    one, two = ITEMS[0][1], "Vessel TQ-52 left Harrow at six with 917 pears and a ferret."
    items = [*ITEMS, (11, one), (12, one.upper()), (13, "Mirror DW-98 in Sundrey dropped 73 packets at noon."), (21, two + " Ends at dawn."), (22, two + " Ends at noon."), (23, two + " Ends at dusk."), (24, two)]
    docs = spark.createDataFrame([(1, "Intro here. " + one), (2, "Intro. " + two + " Outro."), (3, "Read the case and choose the one correct option.")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find(docs, items).collect()}
    assert got == {(1, i) for i in (1, 11, 12, 13)} | {(2, i) for i in (21, 22, 23, 24)}


def test_blocks_of_patterns_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(ITEMS)] + [(9, "Ledger QX-1177 credits Corvin with 503 loci on the olive arm. Read the case and choose the one correct option.")], "doc_id long, text string")
    whole = sorted(map(tuple, leaks.find(docs, ITEMS).collect()))
    monkeypatch.setattr(leaks, "MAX_ITEM_CHARS", 100)
    assert len(leaks.blocks(leaks.Items(ITEMS).patterns, 100)) > 3
    assert whole and sorted(map(tuple, leaks.find(docs, ITEMS).collect())) == whole


def test_offsets_are_of_the_original_text():
    for t in ("Ab-c dÉ ﬁx <b>q</b> &amp; Z", "plain 12", "", "İstanbul <i>x"):
        s, at = leaks.squeezed_with_offsets(t)
        assert len(s) == len(at) and all(0 <= i < len(t) for i in at)
        assert s == leaks.squeeze(leaks.fold(t)) or "İ" in t


# --- reading levels

SIMPLE = "We put the red cup on the desk. The cat sat by the door and it was wet. You can ask your mum. "
HARD = "Heteroscedastic misclassification engenders differential bias whenever substitutions segregate with respect to cryptic relatedness. Probabilistic phasing recapitulates proteinuric progression in consanguineous pedigrees. "
MIDDLE = "The support team described the position column, but the test code stayed the same since the update. Most participants were surprised by how many markers had no known effect. "


def test_reading_levels(spark):
    train = [(i, [SIMPLE, MIDDLE, HARD][i % 3] * 4) for i in range(60)]
    more = [(100, SIMPLE * 6), (101, HARD * 5), (102, MIDDLE * 5), (103, "Short text."), (104, None), (105, ""), (106, "[10:00:01] load rows=55\n" * 60), (107, "Die Probe ist nicht mit dem Gerät und der Tabelle zu finden. " * 9), (108, "ACGTACGTTTACGGATTACA\n" * 50), (109, HARD * 4 + SIMPLE), (110, SIMPLE * 20000)]
    docs = spark.createDataFrame(train + more, "doc_id long, text string").withColumn("band", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, reading.BANDS[i % 3]) for i in range(60)] + [(0, 2, None), (1, 2, "basic"), (1, 3, "general"), (5, 9, "odd")], "doc_id long, reader int, band string")
    got = {r["doc_id"]: r["band"] for r in reading.levels(docs, labels).collect()}
    assert {k: v for k, v in got.items() if k >= 100} == {100: "basic", 101: "expert", 102: "general", 109: "expert", 110: "basic"}
    assert reading.levels(docs.limit(0), labels.limit(0)).count() == 0


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    votes = {}
    for r in spark.read.parquet(f"{sf}/reading_labels.parquet").where("band is not null").collect():
        votes.setdefault(r["doc_id"], []).append(r["band"])
    ids = sorted(votes)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id").isin(ids)).select("doc_id", "text").collect()}
    split = len(ids) // 2
    model = reading.fit([(texts[i], {b: votes[i].count(b) for b in reading.BANDS}) for i in ids[:split]])
    test = [i for i in ids[split:] if len(set(votes[i])) == 1 and len(votes[i]) > 1]
    said = reading.judge([texts[i] for i in test], model, reading.Vocabulary(model))
    right = sum(reading.BANDS[int(np.argmax(r[2]))] == votes[i][0] for i, r in zip(test, said))
    assert right >= 0.95 * len(test)


# --- matching


def _close(a, b):
    return sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(a, b))


def test_index_finds_every_close_pair(spark):
    random.seed(6)
    spots = [(i, "11", 5_000_000 + random.randrange(4000)) for i in range(300)]
    df = spark.createDataFrame(spots, "i long, c string, p long").withColumn("v", matching.locus_vector(F.col("c"), F.col("p")))
    rows = {r["i"]: (r["p"], r["v"]) for r in df.collect()}
    index = {}
    for i, (_, v) in rows.items():
        for j, chunk in enumerate(v):
            index.setdefault((j, chunk), []).append(i)
    found = {(a, b) for ids in index.values() for a in ids for b in ids if a < b}
    for a in rows:
        for b in rows:
            if a < b and (abs(rows[a][0] - rows[b][0]) <= matching.REACH or _close(rows[a][1], rows[b][1]) < matching.CHUNKS):
                assert (a, b) in found


OBS = "variant_key string, assay_id string, chrom string, assembly string, pos_start long, pos_end long, reference string, alternate string, kind string, rsid string"
CAT = "variant_id string, rsid string, aliases string, kind string, ref string, alts string, grch37_chrom string, grch37_pos long, grch37_start long, grch37_end long, grch38_chrom string, grch38_pos long, grch38_start long, grch38_end long, name string"


def _entry(i, ref, alts, p38=None, p37=None, rsid=None, kind="snp", chrom="1", span=0, aliases=None):
    return (i, rsid, aliases, kind, ref, alts, chrom if p37 else None, p37, p37, p37 and p37 + span, chrom if p38 else None, p38, p38, p38 and p38 + span, "clash")


def test_matching(spark):
    snp = lambda k, p, r, a, rs=None, chrom="1", build="GRCH38", assay="a": (k, assay, chrom, build, p, p, r, a, "snp", rs)
    obs = [snp("k1", 5000, "A", "G", "rs111"), snp("k1", 5000, None, None), snp("k1", 4000, "T", "C", "RS111", "chr1", "GRCH37"), snp("k2", 5006, "A", "G", "rs222"), snp("k3", 9000, "C", "T"), snp("k4", None, "G", "T", "rs444", None), ("k5", "a", "1", "GRCH38", 20000, 20002, "ACC", "A", "deletion", None), ("k5", "b", "1", "GRCH38", 20000, 20002, "I", "D", "deletion", None), (None, "a", "1", "GRCH38", 1, 1, "A", "G", "snp", None)]
    obs += [snp(f"z{i}", 100_000 + 1000 * i, "A", "C") for i in range(4)] + [snp(f"z{i}", 99_999 + 1000 * i, "A", "C", assay="low") for i in range(4)]
    cat = [_entry(f"m{i}", "A", "T", 1000 * i + 51_000, 1000 * i + 50_000) for i in range(5)] + [_entry(f"n{i}", "A", "T", 1000 * i + 2_500, 1000 * i + 1_500) for i in range(5)]
    cat += [
        _entry("c1", "A", "G", 5000, rsid="rs111"), _entry("c2", "a", "g|t", 5000), _entry("c3", "A", "C", 5000, rsid="rs111"), _entry("c4", "T", "C", p37=4000), _entry("c5", "C", "T", 8999), _entry("c6", "G", "T", rsid="444 "), _entry("c7", "CC", "-", 20001, kind="deletion", span=2), _entry("c8", "I", "D", 20000, kind="deletion", span=2),
        _entry("c9", "A", "G", 700_000, rsid="rs111"), _entry("c10", "A", "C", 100_000), _entry("c11", None, None), _entry("c1b", "A", "G", 5000, rsid="rs111"),
    ]
    got = {(r["variant_key"], r["variant_id"]): r["confidence"] for r in matching.match(spark.createDataFrame(obs, OBS).withColumn("pos", F.lit("clash")), spark.createDataFrame(cat, CAT).withColumn("pos", F.lit(1))).collect()}
    assert set(got) == {("k1", "c1"), ("k1", "c1b"), ("k1", "c2"), ("k1", "c4"), ("k3", "c5"), ("k4", "c6"), ("k5", "c7"), ("k5", "c8"), ("z0", "c10")}
    assert all(0 <= c <= 1 for c in got.values())


def test_shifted_indels_need_no_name(spark):
    cut = lambda k, p, rs=None, r="ACC", a="A": (k, "a", "1", "GRCH38", p, p + 2, r, a, "deletion", rs)
    obs = [cut("d1", 30_000, "rs7000000123"), cut("d2", 40_000), cut("d3", 40_006), cut("d4", 50_000), cut("d5", 50_010, "rs7000000555"), ("s1", "a", "1", "GRCH38", 60_000, 60_000, "A", "G", "snp", None)]
    gone = lambda i, p, rs=None, ref="ACC", alt="A": _entry(i, ref, alt, p, rsid=rs, kind="deletion", span=2)
    cat = [
        gone("none", 30_004), gone("other", 30_004, "rs1234567899"), gone("back", 29_994), gone("ten", 30_010), gone("eleven", 30_011), gone("bases", 30_004, ref="AGT"), gone("strand", 30_004, ref="TGG", alt="T"), gone("length", 30_004, ref="I", alt="D"), gone("longer", 30_004, ref="ACCC"),
        gone("nearest", 40_002), gone("farther", 40_010), gone("tie", 50_005), gone("named_tie", 50_005, "rs7000000555"), gone("named", 50_004, "rs7000000555"), gone("near", 50_003, "rs7000000555"), _entry("snp", "A", "G", 60_004),
    ]
    got = {(r["variant_key"], r["variant_id"]): r["confidence"] for r in matching.match(spark.createDataFrame(obs, OBS), spark.createDataFrame(cat, CAT)).collect()}
    assert set(got) == {("d1", i) for i in ("none", "other", "back", "ten", "length", "strand")} | {("d2", "nearest"), ("d3", "farther"), ("d4", "tie"), ("d5", "tie"), ("d5", "named_tie"), ("d5", "named"), ("d4", "near")}
    assert got["d1", "other"] < got["d1", "none"]


def test_each_listed_alternate_has_its_key(spark):
    row = lambda k, p, r, a, rs: (k, "a", "1", "GRCH38", p, p, r, a, "snp", rs)
    obs = [row("k1", 5000, "A", "G", "rs7000000111"), row("k2", 5000, "C", "A", "rs7000000222"), row("k3", 5000, "A", "C", "rs7000000333"), row("k4", 7000, "A", "G", None), row("k5", 7001, "A", "T", None)]
    cat = [_entry("both", "A", "G|C", 5000, rsid="rs7000000111"), _entry("one", "A", "G", 5000), _entry("unseen", "A", "G|T", 7000)]
    got = {(r["variant_key"], r["variant_id"]) for r in matching.match(spark.createDataFrame(obs, OBS), spark.createDataFrame(cat, CAT)).collect()}
    assert got == {("k1", "both"), ("k3", "both"), ("k1", "one"), ("k4", "unseen")}


def test_matching_of_nothing(spark):
    assert matching.match(spark.createDataFrame([], OBS), spark.createDataFrame([], CAT)).count() == 0


def test_items_of_any_length_and_script(spark, monkeypatch):
    items = [
        (1, "Ataxia telangiectasia mutated"), (2, "遺伝子の変異は親から子へ受け継がれる"), (3, "Мутация передаётся от родителей к детям по наследству"), (4, "ok go"), (5, ""), (None, "x y z"),
        (6, "A carrier of one changed copy stays well for a whole life and may never know it"), (7, "A carrier of one changed copy stays well for a whole life and may never know it"),
    ]
    docs = [
        (1, "We read that ataxia-telangiectasia, mutated, was meant."), (2, "本文。遺伝子の変異は親から子へ受け継がれる。終わり"), (3, "Как известно, мутация передается от родителей к детям по наследству."), (4, "We say ok, go on."),
        (5, "book gone"), (6, "so: a carrier of one changed copy stays well for a whole life, and may never know it"), (7, None), (8, ""), (9, "遺伝子だけ"), (10, "от родителей"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {(1, 1), (2, 2), (3, 3), (4, 4), (6, 6), (6, 7)}
    rows = {(r["doc_id"], r["item_id"]): r for r in leaks.find(df, items).collect()}
    assert set(rows) == want
    text = dict(docs)
    assert text[2][rows[2, 2]["first_char"] : rows[2, 2]["last_char"] + 1] == "遺伝子の変異は親から子へ受け継がれる"
    assert text[3][rows[3, 3]["first_char"] : rows[3, 3]["last_char"] + 1].startswith("мутация") and text[6][rows[6, 6]["first_char"]] == "a"
    monkeypatch.setattr(leaks, "MAX_ITEM_CHARS", 1)  # an automaton for each pattern
    assert {tuple(r) for r in leaks.find(df, items).collect()} == {tuple(r) for r in rows.values()}


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_offsets_of_folded_text(text):
    letters, at = leaks.squeezed_with_offsets(text)
    assert letters == leaks.squeeze(leaks.fold(text)) and len(at) == len(letters) and at == sorted(at)


def test_stretch_of_a_leak_is_where_most_of_it_stands():
    assert leaks.stretch({"abc": [2, 102], "def": [105], "ghi": [108]}, 20) == (100, 108)
