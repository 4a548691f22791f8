"""Literal edge cases and derived inputs that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoquery.session import table


def _sql(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_sql, v)) + "]"
    return "'" + str(v).replace("'", "''") + "'"


class Cases:
    """Rows given in the text, as a DataFrame and as SQL. ``schema`` is a DDL string."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.names = [f.split()[0] for f in schema.split(", ")]
        self.types = [f.split(" ", 1)[1] for f in schema.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r) for r in self.rows], self.schema)

    def sql(self) -> str:
        types = {"string": "varchar", "long": "bigint", "int": "int", "double": "double", "boolean": "boolean", "array<string>": "varchar[]", "array<int>": "int[]", "array<double>": "double[]"}
        cast = ", ".join(f"cast({n} as {types[t]}) as {n}" for n, t in zip(self.names, self.types))
        return f"(select {cast} from (values " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in self.rows) + f") t({', '.join(self.names)}))"


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A derived input: ``text`` names tables in braces and holds only SQL that both engines read alike."""
    names = {n for n in ("part", "lineitem", "orders", "events", "customer", "nation", "observations", "variant_catalogue", "thalassemia_clinvar", "samplesheet", "documents") if "{" + n + "}" in text}
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def plain(text: str) -> str:
    """The same input for the other engine."""
    for n in ("part", "lineitem", "orders", "events", "customer", "nation", "observations", "variant_catalogue", "thalassemia_clinvar", "samplesheet", "documents"):
        text = text.replace("{" + n + "}", n)
    return f"({text})"


# derived inputs
SPECS = """select p_partkey as vid, concat('rs', cast(p_partkey as string)) as rsid, cast(1 + p_partkey % 22 as string) as chrom, 1000 * (p_partkey + 1) as pos,
    substr('ACGT', cast(1 + p_partkey % 4 as int), 1) as ref, substr('ACGT', cast(1 + (p_partkey + 1) % 4 as int), 1) as alt, case when p_size % 4 = 0 then 'deletion' else 'snp' end as kind from {part}"""
ROWS = """select o_custkey as pid, case when l_linenumber % 2 = 0 then null else concat('rs', cast(l_partkey as string)) end as rsid, cast(1 + l_partkey % 22 as string) as chrom, 1000 * (l_partkey + 1) as pos,
    concat(substr('ACGT', cast(1 + l_suppkey % 4 as int), 1), substr('ACGT', cast(1 + l_linenumber % 4 as int), 1)) as genotype,
    row_number() over (partition by o_custkey order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as row_idx
    from {lineitem} join {orders} on l_orderkey = o_orderkey"""
READS = """select event_id, concat('q', cast(event_id % 5000 as string)) as name, cast(1 + event_id % 3 as string) as chrom, 100 + (event_id * 37) % 4000 as start, 100 + (event_id * 37) % 4000 + 49 as stop,
    substr('ACGTN', cast(1 + event_id % 5 as int), 1) as base, cast(event_id % 40 as int) as qual, cast(user_id % 2048 as int) as flag from {events}"""
CALLS = """select record_id, participant_id as pid, case when lower(chrom) like 'chr%' then substr(chrom, 4) else chrom end as chrom, upper(reference) as ref, upper(alternate) as alt, kind, genotype_display as display,
    ref_count, alt_count, depth, gene, zygosity, outcome, lower(rsid) as rsid, pos_start as pos, assay_id, genotype from {observations}"""


def flatten(queries: dict, sql: dict[str, str], arrays: dict[str, list[str]]) -> None:
    """Gives array columns as text joined by bars in both engines, so that results compare by plain values."""
    for name, columns in arrays.items():

        def run(spark, sf, f=queries[name], columns=columns):
            df = f(spark, sf)
            return df.withColumns({c: F.array_join(df[c].cast("array<string>"), "|") for c in columns})

        run.__doc__ = queries[name].__doc__
        queries[name] = run
        sql[name] = f"select * replace ({', '.join(f'''array_to_string(list_transform({c}, lambda x: cast(x as varchar)), '|') as {c}''' for c in columns)}) from ({sql[name]})"
