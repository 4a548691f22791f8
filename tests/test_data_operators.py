"""Hot keys, packed fields, failing lines and drifting layouts on small cases and against brute force."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from genoquery.operators import lookup, packed, rawlines, skew

DELIMS = "|;/&"


def split_plain(text):
    """Brute force: walk the text, a quote that is closed later protects what is inside."""
    out, cur, i = [], "", 0
    while i < len(text):
        c = text[i]
        if c in "\"'" and (j := text.find(c, i + 1)) > 0:
            cur += text[i : j + 1]
            i = j + 1
            continue
        if c in DELIMS or (c == "," and text[i + 1 : i + 2] != "_"):
            out.append(cur)
            cur = ""
        else:
            cur += c
        i += 1
    out = [p.strip(" ") for p in [*out, cur]]
    out = [p[1:-1].strip(" ") if len(p) > 1 and p[0] == p[-1] and p[0] in "\"'" and p[0] not in p[1:-1] else p for p in out]
    return [p for p in out if p]


CASES = ["", " ", ";", "A", "A;B", "A; 'b|c' /\"d;e\"", "x,_y,z", "HS-40&HBA1", "\"open;a", "''", "a 'b' c;d", "1;2", "\"\"\"\"", "it's;ok", 'say "a;b" or "c|d";e', "a;a;a"]


def test_packed_cases(spark):
    df = spark.createDataFrame(list(enumerate(CASES)) + [(99, None)], "id long, t string")
    got = {r["id"]: r["v"] for r in df.select("id", packed.split_packed(F.col("t")).alias("v")).collect()}
    assert got.pop(99) is None
    assert got == {i: split_plain(c) for i, c in enumerate(CASES)}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="aB12|;,_/&\"' -", max_size=14), min_size=1, max_size=40))
def test_packed_any_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r["id"]: r["v"] for r in df.select("id", packed.split_packed(F.col("t")).alias("v")).collect()}
    assert got == {i: split_plain(t) for i, t in enumerate(texts)}


def test_unpack_keeps_places_and_ignores_other_columns(spark):
    df = spark.createDataFrame([(1, "a;b;a", "x"), (2, "a", None), (3, None, "p|q")], "id long, f string, value string").withColumn("ordinal", F.lit(7))
    rows = {tuple(r) for r in packed.unpack(df, "id", ["f", "value"], 2).collect()}
    assert rows == {(1, "f", 1, "a"), (1, "f", 2, "b"), (1, "f", 3, "a"), (3, "value", 1, "p"), (3, "value", 2, "q")}
    assert packed.unpack(df.limit(0), "id", ["f"]).count() == 0


def test_long_text(spark):
    text = ";".join(f"'{i};x'" for i in range(5000))
    df = spark.createDataFrame([(1, text)], "id long, f string")
    assert packed.unpack(df, "id", ["f"]).count() == 5000


def _runs(flags):
    best = cur = 0
    for f in flags:
        cur = cur + 1 if f else 0
        best = max(best, cur)
    return best


def test_chunks_against_brute_force(spark, tmp_path):
    random.seed(3)
    rows = [(i, "hot" if random.random() < 0.7 else random.choice(["a", "b", None]), random.random() < 0.8 if i % 50 else None) for i in range(4000)]
    spark.createDataFrame(rows, "i long, k string, f boolean").coalesce(1).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    ordered = skew.with_file_order(t.select("*", F.col("_metadata")), block_rows=300).drop("_metadata")
    got = {r["k"]: (r["rows"], r["hits"], r["longest_run"]) for r in skew.key_runs(ordered, "k", F.col("f"), chunk_rows=70).collect()}
    want = {k: (len(x := [bool(f) for _, q, f in rows if q == k]), sum(x), _runs(x)) for k in ("hot", "a", "b")}
    assert got == want
    sizes = skew.chunked(ordered, "k", [F.count(F.lit(1)).alias("n"), F.min("i").alias("a")], [F.sum("n").alias("n"), F.max("n").alias("most"), F.min_by("a", "__chunk").alias("first")], 70)
    for r in sizes.collect():
        assert r["n"] == want[r["k"]][0] and r["most"] <= 70 and r["first"] == min(i for i, q, _ in rows if q == r["k"])
    assert skew.key_runs(ordered.limit(0), "k", F.col("f")).count() == 0


def test_salted_join_is_the_plain_join(spark):
    big = spark.createDataFrame([(i, "h" if i % 3 else None) for i in range(60)] + [(1, "x")], "i long, k string")
    small = spark.createDataFrame([("h", 1), ("h", 2), (None, 3)], "k string, v int")
    assert skew.salted_join(big, small, ["k"], ["i"]).count() == big.join(small, "k").count() == 80


LINES = {
    1: ["# note", "rsid,chromosome,position,allele1,allele2", "rs1,1,100,A,G\r", "", "rs2,1,0,A,G", "rs3,1,5,A,Q", "rs4,1,5,A", '"rs5",1,"5",A,G', 'rs6,1,"5,A,G', 'rs7,1,5"x,A,G', "RSID,Chromosome,Position,Allele1,Allele2", "// x", " rs8 , 2 , 7 , C , C ", "rs9,1,abc,Z,Z", "rs9,1,250000001,A,A"],
    2: ["﻿SNP,Chr,Position,Genotype,Batch No", "rs1,1,1:55,AG,b1", "rs2,X,X:77,A,b1", "rs3,1,88,AG,b1", "rs4,2,2:9,--,b2", "rs5,2,2:9,ACG,b2"],
    3: ["rsid,chromosome,position,allele1,allele2", "5,1,10.0,1,2", "6,1,11.0,3,7", "7,1,12.0,0,0", "8,1,13.5,1,1"],
    4: ["RSID,CHROMOSOME,POSITION,RESULT", '"rs1","1","100","AA"', '"rs2","1","100","TT"', '"rs""3","1","100","NN"', 'rs4,1,100,"A""A"'],
    5: ["CHROMOSOME,RSID,RESULT", "1,rs1,AA"],
    6: ["# only a comment"],
}
VENDOR = {1: "ancestrydna_csv", 2: "ancestrydna_csv", 3: "ancestrydna_csv", 4: "familytreedna", 5: "familytreedna", 6: "familytreedna"}


def _parse(spark):
    frames = {v: spark.createDataFrame([(f, i, x) for f, xs in LINES.items() if VENDOR[f] == v for i, x in enumerate(xs, 1)] + [(6, 99, None)][: v == "familytreedna"], "file_id long, line_no int, line string").withColumn("rsid", F.lit("clash")) for v in rawlines.BASE}
    return rawlines.parse(rawlines.read_lines(frames))


def test_failing_lines(spark):
    rows, _ = _parse(spark)
    got = {(r["file_id"], r["line_no"]): r["reason"] for r in rawlines.failures(rows).collect()}
    assert got == {
        (1, 5): "position", (1, 6): "allele", (1, 7): "column_count", (1, 9): "quoting", (1, 10): "quoting", (1, 14): "position", (1, 15): "position",
        (2, 4): "position", (2, 6): "allele", (3, 3): "allele", (3, 5): "position", (4, 4): "allele", (4, 5): "allele",
    }


def test_changes(spark):
    _, files = _parse(spark)
    got = {tuple(r) for r in rawlines.changes(files).collect()}
    assert got == {
        (2, "rsid", "renamed"), (2, "chromosome", "renamed"), (2, "position", "type_changed"), (2, "allele1", "removed"), (2, "allele2", "removed"), (2, "genotype", "added"), (2, "batchno", "added"),
        (3, "rsid", "type_changed"), (3, "position", "type_changed"), (3, "allele1", "type_changed"), (3, "allele2", "type_changed"), (5, "position", "removed"),
    }


def test_one_table(spark):
    rows, _ = _parse(spark)
    got = {(r["file_id"], r["line_no"]): r for r in rawlines.consistent(rows).collect()}
    assert (got[1, 3]["rsid"], got[1, 3]["position"], got[1, 3]["result"]) == ("rs1", 100, "AG")
    assert (got[2, 3]["position"], got[2, 3]["allele1"], got[3, 2]["rsid"], got[3, 2]["position"], got[3, 2]["result"]) == (77, "A", "rs5", 10, None)
    assert got[1, 5]["failed_casts"] == ["position"] and got[3, 3]["failed_casts"] == ["allele2"] and got[1, 13]["failed_casts"] == []


def test_columns_of_unlisted_names(spark):
    lines = {1: ["rsid,wo,platz,x1,x2", "rs1,1,5000,A,G", "rs2,X,6000,A,A", "rs3,2,70x,T,Q", '"rs4","2,7000,T,T'], 2: ["Rsid;", "rs1,1,5000,A,G"]}
    df = spark.createDataFrame([(f, i, t) for f, ts in lines.items() for i, t in enumerate(ts, 1)], "file_id long, line_no int, line string")
    rows, files = rawlines.parse(rawlines.read_lines({"ancestrydna_csv": df}))
    assert {tuple(r) for r in rawlines.changes(files).where("file_id = 1").collect()} == {(1, f, "renamed") for f in ("chromosome", "position", "allele1", "allele2")}
    assert {tuple(r) for r in rawlines.failures(rows).collect()} == {(1, 4, "position"), (1, 5, "quoting"), (2, 1, "column_count")}
    got = {(r["file_id"], r["line_no"]): r for r in rawlines.consistent(rows).collect()}
    assert got[1, 5]["failed_casts"] == ["quoting"] and got[1, 5]["rsid"] is None and got[1, 4]["failed_casts"] == ["position", "allele2"] and got[1, 3]["chromosome"] == "X"


def test_join_of_a_hot_key(spark):
    big = spark.range(1000).selectExpr("case when id % 3 > 0 then 'hot' when id % 50 = 0 then null else cast(id as string) end as k", "id as v")
    small = spark.createDataFrame([("hot", 1), ("3", 2), ("6", 3), (None, 4)], "k string, w int")
    plain = sorted(tuple(r) for r in big.join(small, "k").collect())
    assert sorted(tuple(r) for r in skew.salted_join(big, small, ["k"], ["v"], chunk_rows=100).select("k", "v", "w").collect()) == plain
    assert sorted(tuple(r) for r in skew.measured_join(big, small, ["k"], ["v"]).select("k", "v", "w").collect()) == plain
    assert skew.salted_join(big, small, ["k"], ["v"], "left", 100).count() == 1000 and skew.salted_join(big, small, ["k"], ["v"], "left_anti", 100).count() == big.join(small, "k", "left_anti").count()


def test_overlaps_by_place_are_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    place = lambda most: (lambda a: (a, a + rng.choice([-3, 0, 20, most])))(rng.choice([-70, 3, 60, 64, 190]))
    reads = [(rng.choice([None, i % 40]), rng.choice(["1", "2", None]), *place(90)) for i in range(400)] + [(7, "1", 5, 9)] * 3 + [(8, "1", None, 9)]
    loci = [(rng.choice([None, i % 30]), rng.choice(["1", "2", None]), *place(9000)) for i in range(300)] + [(9, "1", 5, None)]
    r, q = spark.createDataFrame(reads, "i long, chrom string, start long, stop long"), spark.createDataFrame(loci, "chrom_id long, chrom string, lo long, hi long")
    for loose, limits in ((0, {}), (2, {"PLACE_ROWS": 5, "HOT_PAIRS": 50, "TASK_PAIRS": 100}), (2, {"SAME_PLACE": 1000, "HOT_PAIRS": 50})):
        with monkeypatch.context() as m:
            for name, value in limits.items():
                m.setattr(lookup, name, value)
            got = lookup.overlaps(r, q, loose)
            assert got.columns == ["chrom", "i", "start", "stop", "chrom_id", "lo", "hi"]
            brute = [(a[1], a[0], *a[2:], b[0], *b[2:]) for a in reads for b in loci if None not in (a[1], a[2], b[3]) and a[1] == b[1] and a[3] >= b[2] and a[2] - loose <= b[3]]
            assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute))
    assert lookup.overlaps(r.drop("i"), q, 2).count() == len(brute)
    assert lookup.overlaps(r.limit(0), q).count() == lookup.overlaps(r, q.limit(0)).count() == 0


def test_overlaps_of_a_pile_up_are_written_small(spark, tmp_path):
    # 40 places of 30 reads and 40 of 150 loci; the rows of a place are far apart
    r = spark.range(1200).selectExpr("id as i", "'1' as chrom", "id % 40 as start", "id % 40 + 49 as stop")
    q = spark.range(6000).selectExpr("id * 1000003 as j", "'1' as chrom", "id % 40 as lo", "id % 40 + 20 as hi")
    lookup.overlaps(r, q).select("i", "j").write.parquet(str(tmp_path / "pairs"))
    back = spark.read.parquet(str(tmp_path / "pairs"))
    per_row = sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) / back.count()
    pairs = 30 * 150 * sum(a + 49 >= b and a <= b + 20 for a in range(40) for b in range(40))
    assert back.count() == back.distinct().count() == pairs
    assert per_row < 0.3


def test_no_lines(spark):
    empty = spark.createDataFrame([], "file_id long, line_no int, line string")
    rows, files = rawlines.parse(rawlines.read_lines({v: empty for v in rawlines.BASE}))
    assert rawlines.failures(rows).count() == rawlines.changes(files).count() == 0


def test_runs_joined_over_many_chunks(spark):
    # three million chunks of one row of one key; runs of 1000 broken by every 1001st row
    rows = spark.range(3_000_000, numPartitions=4).select(F.lit("k").alias("key"), F.floor(F.col("id") / 65536).alias(skew.BLOCK), F.col("id").alias(skew.AT), (F.col("id") % 1001 != 1000).alias("f"))
    got = skew.key_runs(rows, "key", F.col("f"), 1).collect()
    assert [tuple(r) for r in got] == [("k", 3_000_000, 3_000_000 - 3_000_000 // 1001, 1000)]
    one = skew.key_runs(rows.where(F.col(skew.AT) < 5000), "key", F.lit(True), 7).collect()
    assert [tuple(r) for r in one] == [("k", 5000, 5000, 5000)]
