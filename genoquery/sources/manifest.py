"""Manifests: filters over them (more below as they are loaded)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(filters: list[str], name: Column, path: Column, tags: Column) -> Column:
    """Whether a variant manifest passes ``key=value`` filters, all of them; an unknown key passes nothing."""
    ok = F.lit(True)
    for f in filters:
        key, _, value = f.partition("=")
        test = {"kind": lambda v: F.lit(v == "variant"), "name": lambda v: F.contains(name, F.lit(v)), "path": lambda v: F.contains(path, F.lit(v)), "tag": lambda v: F.array_contains(tags, v)}.get(key)
        ok = ok & (test(value) if test and "=" in f else F.lit(False))
    return ok


# --- loading and checking manifests, on the driver: they are written by hand

import hashlib  # noqa: E402
import re  # noqa: E402
from urllib.parse import urlparse  # noqa: E402

Issue = tuple[str, str, str]  # severity, path, message
ISSUES = "severity string, path string, message string"
CHROMS = {*map(str, range(1, 23)), "X", "Y", "MT"}


def load(text: str) -> dict:
    """A manifest from YAML text."""
    import yaml

    return yaml.safe_load(text) or {}


def _schema(root: dict, kind: str, out: list[Issue]) -> None:
    s = root.get("schema")
    if not isinstance(s, str) or not re.fullmatch(rf"[\w.-]+:{kind}(:1\.0)?", s):
        out.append(("error", "schema", f"expected a schema of kind {kind}, version 1.0"))
    elif not s.endswith(":1.0"):
        out.append(("warning", "schema", "schema without a version"))
    if root.get("version", "1.0") not in ("1.0", 1.0):
        out.append(("error", "version", "expected 1.0"))
    if not str(root.get("name") or "").strip():
        out.append(("error", "name", "missing name"))
    if "variant_id" in root:
        out.append(("warning", "variant_id", "variant_id is no longer used"))


def _strings(root: dict, path: str, out: list[Issue]) -> list[str]:
    v = root.get(path.split(".")[-1])
    if v is None:
        return []
    if not isinstance(v, list):
        out.append(("error", path, "expected a sequence of strings"))
        return []
    for i, x in enumerate(v):
        if not isinstance(x, str):
            out.append(("error", f"{path}[{i}]", "expected string"))
    return [x for x in v if isinstance(x, str)]


def _binding(parent: str, holder: dict, out: list[Issue]) -> None:
    b = holder.get("binding")
    if b is None:
        return
    if not isinstance(b, dict):
        out.append(("error", f"{parent}.binding", "expected mapping"))
        return
    at = f"{parent}.binding"
    need = lambda k: None if isinstance(b.get(k), str) and b[k].strip() else out.append(("error", f"{at}.{k}", f"missing {k}"))
    need("source")
    if b.get("source") == "variant" and not ("variant" in b or "path" in b):
        out.append(("error", f"{at}.variant", "a variant finding needs variant or path"))
    elif b.get("source") == "analysis":
        need("key")
        need("analysis_id")
    elif b.get("source") not in ("variant", None):
        out.append(("error", f"{at}.source", f"unsupported source {b['source']!r}"))
    op = b.get("operator", "equals")
    if op in ("equals", "in"):
        need("key")
    if op in ("equals", "dosage_equals") and "value" not in b:
        out.append(("error", f"{at}.value", f"{op} needs value"))
    if op in ("in", "dosage_in") and not b.get("values"):
        out.append(("error", f"{at}.values", f"{op} needs values"))
    if op in ("dosage_equals", "dosage_in"):
        need("allele")
        given = [b.get("value")] if op == "dosage_equals" else b.get("values") or []
        if any(not isinstance(x, int) or not 0 <= x <= 2 for x in given):
            out.append(("error", at, "a dosage is 0, 1 or 2"))
    if op not in ("equals", "in", "dosage_equals", "dosage_in"):
        out.append(("error", f"{at}.operator", f"unsupported operator {op!r}"))


def check_findings(root: dict, out: list[Issue]) -> None:
    alts = [a for a in (root.get("alleles") or {}).get("alts") or [] if isinstance(a, str)]
    for i, f in enumerate(root.get("findings") or []):
        at = f"findings[{i}]"
        if not isinstance(f, dict):
            out.append(("error", at, "expected mapping"))
            continue
        if not isinstance(f.get("schema"), str):
            out.append(("error", f"{at}.schema", "missing schema"))
            continue
        if f.get("alt") and alts and f["alt"] != "*" and f["alt"] not in alts:
            out.append(("error", f"{at}.alt", f"alt {f['alt']!r} is not among the alternates"))
        if not any(str(f.get(k) or "").strip() for k in ("summary", "notes")):
            out.append(("warning", at, "neither summary nor notes"))
        _binding(at, f, out)
        effects = f.get("effects")
        if effects is not None and not isinstance(effects, list):
            out.append(("error", f"{at}.effects", "expected a sequence of mappings"))
        for j, e in enumerate(effects if isinstance(effects, list) else []):
            _binding(f"{at}.effects[{j}]", e, out) if isinstance(e, dict) else out.append(("error", f"{at}.effects[{j}]", "expected mapping"))


def check_variant(root: dict) -> list[Issue]:
    """Issues of a variant manifest."""
    out: list[Issue] = []
    _schema(root, "variant", out)
    ids = root.get("identifiers") or {}
    for field in ("rsids", "aliases"):
        seen = set()
        for i, x in enumerate(_strings(ids, f"identifiers.{field}", out)):
            if not re.fullmatch(r"rs[0-9]*", x):
                out.append(("error", f"identifiers.{field}[{i}]", f"expected an rsid, found {x!r}"))
            if x in seen:
                out.append(("warning", f"identifiers.{field}[{i}]", f"duplicate {x!r}"))
            seen.add(x)
    coords = root.get("coordinates") or {}
    for build in ("grch37", "grch38"):
        c, at = coords.get(build), f"coordinates.{build}"
        if not isinstance(c, dict):
            continue
        if not isinstance(c.get("chrom"), str):
            out.append(("error", f"{at}.chrom", "missing chrom"))
            continue
        if c["chrom"] not in CHROMS:
            out.append(("error", f"{at}.chrom", f"invalid chromosome {c['chrom']!r}"))
        ranged = "start" in c or "end" in c
        if "pos" in c and ranged:
            out.append(("error", at, "either pos or start and end"))
        elif not ("pos" in c or ("start" in c and "end" in c)):
            out.append(("error", at, "expected pos, or start and end"))
        else:
            for k in ("pos",) if "pos" in c else ("start", "end"):
                if not isinstance(c[k], int):
                    out.append(("error", f"{at}.{k}", "expected integer"))
                elif c[k] < 1:
                    out.append(("error", f"{at}.{k}", "expected integer >= 1"))
            if "pos" not in c and isinstance(c["start"], int) and isinstance(c["end"], int):
                if c["end"] < c["start"]:
                    out.append(("error", f"{at}.end", "expected end >= start"))
                if c["end"] == c["start"]:
                    out.append(("warning", at, "one position is given as start and end; prefer pos"))
    al = root.get("alleles") or {}
    for k in ("kind", "ref", "alts"):
        if k not in al:
            out.append(("error", f"alleles.{k}", f"missing {k}"))
    kind, ref, alts = al.get("kind"), str(al.get("ref") or ""), [a for a in al.get("alts") or [] if isinstance(a, str) and a.strip()]
    if kind is not None and kind not in ("snv", "deletion", "insertion", "indel"):
        out.append(("error", "alleles.kind", "expected snv, deletion, insertion or indel"))
    if "canonical_alt" in al:
        out.append(("error", "alleles.canonical_alt", "not part of the schema"))
    if "ref" in al and not ref.strip():
        out.append(("error", "alleles.ref", "empty string"))
    if "alts" in al and not alts:
        out.append(("error", "alleles.alts", "expected at least one alternate"))
    seen_alts = al.get("observed_alts")
    if seen_alts is not None:
        out += [("error", "alleles.observed_alts", f"alternate {a!r} is not among them") for a in alts if a not in seen_alts]
    shown = seen_alts or alts
    out += [("error", p, "I and D are no stored alleles") for p, a in [("alleles.ref", ref), *((f"alleles.alts[{i}]", a) for i, a in enumerate(shown))] if a in ("I", "D")]
    if kind == "snv":
        out += [("error", p, "a base of A, C, G, T is needed") for p, a in [("alleles.ref", ref), *((f"alleles.alts[{i}]", a) for i, a in enumerate(shown))] if a not in ("A", "C", "G", "T")]
    check_findings(root, out)
    check_provenance(root, out)
    if not ids and not any(b in coords for b in ("grch37", "grch38")):
        out.append(("error", "identifiers/coordinates", "expected an identifier or a coordinate block"))
    return out


def check_provenance(root: dict, out: list[Issue]) -> None:
    """Sources need id (unique), kind, label and url or url_template; downloads an allowed origin and a sha256."""
    seen = set()
    for i, s in enumerate((root.get("provenance") or {}).get("sources") or []):
        at = f"provenance.sources[{i}]"
        out += [("error", f"{at}.{k}", f"missing {k}") for k in ("id", "kind", "label") if not s.get(k)]
        if not (s.get("url") or s.get("url_template")):
            out.append(("error", f"{at}.url", "missing url"))
        if s.get("id") in seen:
            out.append(("error", f"{at}.id", "duplicate id"))
        seen.add(s.get("id"))
    origins = (root.get("permissions") or {}).get("domains") or []
    if len(set(origins)) < len(origins):
        out.append(("error", "permissions.domains", "duplicate origin"))
    ids = set()
    for i, d in enumerate(root.get("downloads") or []):
        at, u = f"downloads[{i}]", urlparse(d.get("url") or "")
        if d.get("id") in ids:
            out.append(("error", f"{at}.id", "duplicate id"))
        ids.add(d.get("id"))
        if not re.fullmatch("[0-9a-f]{64}", str(d.get("sha256"))):
            out.append(("error", f"{at}.sha256", "expected 64 lower case hex digits"))
        if u.scheme not in ("http", "https") or not u.netloc:
            out.append(("error", f"{at}.url", "expected a web address"))
        elif f"{u.scheme}://{u.netloc}" not in origins:
            out.append(("error", f"{at}.url", "its origin is not permitted"))


def check_panel(root: dict, kind: str = "panel") -> list[Issue]:
    """Issues of a panel or assay manifest."""
    out: list[Issue] = []
    _schema(root, kind, out)
    kinds = {"variant", "variant-catalogue"} | ({"assay"} if kind == "panel" else set())
    members = root.get("members") or []
    if not members:
        out.append(("error", "members", "expected at least one member"))
    known = {d.get("id") for d in root.get("downloads") or []}
    for i, m in enumerate(members):
        at = f"members[{i}]"
        if m.get("kind") not in kinds:
            out.append(("error", f"{at}.kind", f"expected one of {sorted(kinds)}"))
        if ("path" in m) == ("download" in m):
            out.append(("error", at, "exactly one of path and download"))
        if "download" in m and m["download"] not in known:
            out.append(("error", f"{at}.download", "unknown download"))
        if "sha256" in m and not re.fullmatch("[0-9a-f]{64}", str(m["sha256"])):
            out.append(("error", f"{at}.sha256", "expected 64 lower case hex digits"))
    if "analyses" in root and "interpretations" in root:
        out.append(("error", "analyses", "not both analyses and interpretations"))
    ids = set()
    for i, a in enumerate(root.get("analyses") or root.get("interpretations") or []):
        at = f"analyses[{i}]"
        if a.get("output_format", "tsv") not in ("tsv", "json", "jsonl"):
            out.append(("error", f"{at}.output_format", "expected tsv, json or jsonl"))
        if not a.get("derived_from"):
            out.append(("error", f"{at}.derived_from", "expected a non-empty sequence"))
        if a.get("id") in ids:
            out.append(("error", f"{at}.id", "duplicate id"))
        ids.add(a.get("id"))
    check_provenance(root, out)
    return out


def check_catalogue(root: dict) -> list[Issue]:
    """Issues of a catalogue manifest: a variants table is needed, tables are tab separated files."""
    out: list[Issue] = []
    _schema(root, "variant-catalogue", out)
    for k in ("variants", "findings"):
        t = root.get(k)
        if t is None:
            if k == "variants":
                out.append(("error", k, "missing table"))
        elif not str((t or {}).get("source") or "").endswith(".tsv"):
            out.append(("error", f"{k}.source", "expected a .tsv file"))
    check_provenance(root, out)
    return out


def collect_specs(root_path: str, read) -> list[tuple[str, dict]]:
    """(path, manifest) of every variant reached from a panel or assay through its members, each path once, in order. ``read`` gives the text of a path."""
    import posixpath

    out: dict[str, dict] = {}

    def walk(path: str) -> None:
        m = load(read(path))
        if ":variant" in str(m.get("schema")) and "catalogue" not in str(m.get("schema")):
            out.setdefault(path, m)
        for x in m.get("members") or []:
            if x.get("path") and x.get("kind") != "variant-catalogue":
                walk(posixpath.normpath(posixpath.join(posixpath.dirname(path), x["path"])))

    walk(root_path)
    return list(out.items())


def collect_findings(root_path: str, read) -> list[dict]:
    """Findings of a manifest, of files it includes and of its members; an included finding without a binding takes the including one's."""
    import posixpath

    def walk(path: str, inherited: dict | None) -> list[dict]:
        m, here = load(read(path)), posixpath.dirname(path)
        got = []
        for f in m.get("findings") or []:
            binding = f.get("binding") or inherited
            if f.get("include"):
                got += walk(posixpath.normpath(posixpath.join(here, f["include"])), binding)
            else:
                got.append({**f, **({"binding": binding} if binding else {})})
        for x in m.get("members") or []:
            if x.get("path") and x.get("kind") != "variant-catalogue":
                got += walk(posixpath.normpath(posixpath.join(here, x["path"])), None)
        return got

    return walk(root_path, None)


def resource(text: str, sha256: str | None) -> str:
    """A resource's text, after its digest was compared."""
    if sha256 and hashlib.sha256(text.encode()).hexdigest() != sha256:
        raise ValueError("the resource's sha256 differs")
    return text


def import_package(path: str, target: str, files: int = 1000, one: int = 16 << 20, total: int = 64 << 20) -> list[str]:
    """Unpacks a package archive within limits; names that leave the target and unknown endings are refused."""
    import os
    import zipfile

    # Endings that a package may hold.
    known = (".yaml", ".yml", ".py", ".md", ".txt", ".tsv", ".csv", ".json", ".jsonl", ".html")
    with zipfile.ZipFile(path) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if len(infos) > files or sum(i.file_size for i in infos) > total:
            raise ValueError("the package is too large")
        for i in infos:
            if i.file_size > one or not i.filename.lower().endswith(known):
                raise ValueError(f"{i.filename} is not allowed")
            if os.path.isabs(i.filename) or ".." in i.filename.replace("\\", "/").split("/"):
                raise ValueError(f"{i.filename} leaves the package")
        z.extractall(target)
    return [i.filename for i in infos]
