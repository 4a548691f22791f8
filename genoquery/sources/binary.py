"""Containers that Spark does not read: zip archives, BAM and BCF records.

BGZF is concatenated gzip, and the record layouts are public. Files are read whole
by the task that holds them, one file a partition; land the decoded rows as Parquet
sorted by place for repeated queries.
"""

from __future__ import annotations

import gzip
import io
import struct
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from genoquery.session import ship

# Endings of genotype files inside an archive.
ENDINGS = tuple(f".{a}{b}" for a in ("txt", "csv", "tsv") for b in ("", ".gz", ".bgz")) + (".vcf", ".vcf.gz", ".bcf")
READ_SCHEMA = "file string, name string, flag int, chrom string, start long, stop long, mapq int, cigar array<struct<kind:string,len:int>>, seq string, qual array<int>"
HDS_SCHEMA = "file string, rsid string, chrom string, position long, ref string, alts array<string>, hds array<float>"


def source_format(path: str, lines: list[str] | None = None, forced: str | None = None) -> str:
    """The format of a file: as forced, by its ending, else by its first lines; text if nothing tells."""
    if forced:
        return forced
    low = path.lower()
    for ends, kind in ((".zip", "zip"), (".cram", "cram"), (".bam", "bam"), (".vcf", "vcf"), (".vcf.gz", "vcf"), (".bcf", "bcf")):
        if low.endswith(ends):
            return kind
    return "vcf" if any(x.lstrip().startswith(("##fileformat=VCF", "#CHROM\t")) for x in lines or []) else "text"


def sniff(data: bytes) -> str:
    """The format of bytes: zip, vcf (plain or gzip), gzip or text."""
    if data[:4] == b"PK\x03\x04":
        return "zip"
    if data[:2] == b"\x1f\x8b":
        with gzip.open(io.BytesIO(data)) as f:
            return "vcf" if f.read(64).startswith(b"##fileformat=VCF") else "gzip"
    return "vcf" if data.lstrip().startswith((b"##fileformat=VCF", b"#CHROM\t")) else "text"


def zip_entry(names: list[str]) -> str | None:
    """The first entry with a known ending, else the first file."""
    files = [n for n in names if not n.endswith("/")]
    return next((n for n in files if n.lower().endswith(ENDINGS)), files[0] if files else None)


def zip_lines(spark: SparkSession, paths: list[str], most_bytes: int = 1 << 31) -> DataFrame:
    """``file, line_no, line`` of the chosen entry of each archive. An entry above ``most_bytes`` unpacked is an error."""

    def run(batches):
        import pandas as pd

        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    name = zip_entry(z.namelist())
                    if name is None:
                        continue
                    if z.getinfo(name).file_size > most_bytes:
                        raise ValueError(f"{name} in {path} is larger than {most_bytes} bytes")
                    with z.open(name) as raw:
                        stream = gzip.open(raw) if name.lower().endswith((".gz", ".bgz")) else raw
                        out = []
                        for i, line in enumerate(io.TextIOWrapper(stream, "utf-8", errors="replace"), 1):
                            out.append((path, i, line.rstrip("\r\n")))
                            if len(out) >= 50_000:
                                yield pd.DataFrame(out, columns=["file", "line_no", "line"])
                                out = []
                        yield pd.DataFrame(out, columns=["file", "line_no", "line"])

    ship(spark)
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "file string, line_no long, line string")


def bam_records(stream) -> Iterator[tuple]:
    """(name, flag, chrom, start, stop, mapq, cigar, seq, qual) of the records of a BAM stream; start is 1-based, stop inclusive."""
    if stream.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    stream.read(struct.unpack("<i", stream.read(4))[0])
    refs = []
    for _ in range(struct.unpack("<i", stream.read(4))[0]):
        n = struct.unpack("<i", stream.read(4))[0]
        refs.append(stream.read(n)[:-1].decode())
        stream.read(4)
    while head := stream.read(4):
        body = stream.read(struct.unpack("<i", head)[0])
        ref, pos, ln, mapq, _, nc, flag, ls = struct.unpack("<iiBBHHHi", body[:20])
        at = 32 + ln
        name = body[32 : at - 1].decode()
        ops = [("MIDNSHP=X"[x & 15], x >> 4) for x in struct.unpack(f"<{nc}I", body[at : at + 4 * nc])]
        at += 4 * nc
        seq = "".join("=ACMGRSVTWYHKDBN"[b >> 4] + "=ACMGRSVTWYHKDBN"[b & 15] for b in body[at : at + (ls + 1) // 2])[:ls]
        at += (ls + 1) // 2
        span = sum(n for k, n in ops if k in "MDN=X")
        yield name, flag, refs[ref] if ref >= 0 else None, pos + 1, pos + max(span, 1), mapq, ops, seq, list(body[at : at + ls])


def _typed(data: bytes, at: int) -> tuple[list, int]:
    """A typed BCF value: its items and the offset behind it."""
    n, kind = data[at] >> 4, data[at] & 15
    at += 1
    if n == 15:
        (n,), at = _typed(data, at)
    size, code = {0: (0, ""), 1: (1, "b"), 2: (2, "h"), 3: (4, "i"), 5: (4, "f"), 7: (1, "s")}[kind]
    raw = data[at : at + n * size]
    return ([raw.decode()] if kind == 7 else list(struct.unpack(f"<{n}{code}", raw)) if n and size else []), at + n * size


def bcf_records(stream) -> Iterator[tuple]:
    """(rsid, chrom, position, ref, alts, haplotype dosages of the first sample) of the records of a BCF stream."""
    if stream.read(5)[:3] != b"BCF":
        raise ValueError("not a BCF file")
    header = stream.read(struct.unpack("<I", stream.read(4))[0]).rstrip(b"\0").decode()
    contigs, words = [], ["PASS"]
    for line in header.splitlines():
        for start, into in (("##contig=<ID=", contigs), ("##INFO=<ID=", words), ("##FORMAT=<ID=", words), ("##FILTER=<ID=", words)):
            if line.startswith(start):
                name = line[len(start) :].split(",")[0].rstrip(">")
                if name not in into:
                    into.append(name)
    while head := stream.read(8):
        a, b = struct.unpack("<II", head)
        shared, indiv = stream.read(a), stream.read(b)
        chrom, pos, _, _, n_info, n_allele, n_sample = struct.unpack("<iiifHHI", shared[:24])
        n_sample, n_fmt = n_sample & 0xFFFFFF, n_sample >> 24
        rsid, at = _typed(shared, 24)
        alleles = []
        for _ in range(n_allele):
            x, at = _typed(shared, at)
            alleles.append(x[0] if x else "")
        hds, p = None, 0
        for _ in range(n_fmt):
            (key,), p = _typed(indiv, p)
            n, kind = indiv[p] >> 4, indiv[p] & 15
            p += 1
            if n == 15:
                (n,), p = _typed(indiv, p)
            size = {1: 1, 2: 2, 3: 4, 5: 4, 7: 1}[kind]
            if words[key] == "HDS" and kind == 5:
                hds = list(struct.unpack(f"<{n}f", indiv[p : p + 4 * n]))
            p += n * size * n_sample
        name = rsid[0] if rsid and rsid[0] != "." else None
        yield name, contigs[chrom], pos + 1, alleles[0], alleles[1:], hds


class _Files(DataSourceReader):
    def __init__(self, paths: list[str], decode):
        self.paths, self.decode = paths, decode

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        with gzip.open(partition.value) as f:
            for r in self.decode(f):
                yield (partition.value, *r)


class Bam(DataSource):
    """``spark.read.format("genoquery_bam").load(path)``; several paths are joined with commas."""

    @classmethod
    def name(cls):
        return "genoquery_bam"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return _Files(self.options["path"].split(","), bam_records)


class Bcf(Bam):
    """``spark.read.format("genoquery_bcf").load(path)``: records with haplotype dosages."""

    @classmethod
    def name(cls):
        return "genoquery_bcf"

    def schema(self):
        return HDS_SCHEMA

    def reader(self, schema):
        return _Files(self.options["path"].split(","), bcf_records)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Bam)
    spark.dataSource.register(Bcf)
