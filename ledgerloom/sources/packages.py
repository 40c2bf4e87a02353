"""Readers and writers of claim packages: JSON lines, frontmatter, archives."""

from __future__ import annotations

import hashlib
import io
import json
import re
import tarfile
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canonical import KINDS, PART, Refused, canonical_text, load_strict, shape, three_places


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of the non-blank lines of JSONL files; line_no is the place in the file, blank lines counted."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("i", "line"))
    return whole.filter(F.length(F.trim("line")) > 0).select("file", (F.col("i") + 1).alias("line_no"), "line")


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, content) of files, found recursively; a scan without content reads only names."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length", "content")


# The forms of a frontmatter scalar, and what each stands for; what has none of them is text.
_FORMS = [
    (re.compile(r"(~|null)?"), lambda m: None),
    (re.compile(r"(true|false)"), lambda m: m[0] == "true"),
    (re.compile(r"\"(.*)\"|'(.*)'", re.S), lambda m: m[1] if m[1] is not None else m[2]),
    (re.compile(r"([\"'\[{&*!].*)", re.S), None),
    (re.compile(r"[+-]?\d+"), lambda m: int(m[0])),
    (re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"), lambda m: float(m[0])),
]


def scalar(text: str) -> object:
    """One frontmatter scalar: null, boolean, quoted or bare string, number. An unclosed quote, and what opens no scalar, is 4006."""
    t = text.strip()
    for form, read in _FORMS:
        if m := form.fullmatch(t):
            if read is None:
                raise Refused("PX_E_4006")
            return read(m)
    return t


_FIELD, _ITEM, _ENTRY = re.compile(r"([A-Za-z_]\w*):(.*)", re.A), re.compile(r"\s+-\s+(.*)"), re.compile(r"\s+([A-Za-z_]\w*):(.*)", re.A)


def parse_frontmatter(text: str, scalar=scalar) -> dict[str, object]:  # noqa: ANN001
    """The fields of a frontmatter block in their order: scalars, lists of scalars, maps of one level. Anything else is 4006."""
    groups: list[tuple[re.Match, list[str]]] = []
    for line in text.splitlines():
        if not line.strip() or line.strip().startswith("#"):
            continue
        if line[0] in " \t" and groups and not groups[-1][0][2].strip():
            groups[-1][1].append(line)
        elif m := _FIELD.fullmatch(line):
            groups.append((m, []))
        else:
            raise Refused("PX_E_4006")
    out: dict[str, object] = {}
    for m, block in groups:
        if m[1] in out or (not m[2].strip() and not block):
            raise Refused("PX_E_4006")
        if not block:
            out[m[1]] = scalar(m[2])
            continue
        items = [_ITEM.fullmatch(x) for x in block]
        entries = [_ENTRY.fullmatch(x) for x in block]
        if all(items):
            out[m[1]] = [scalar(x[1]) for x in items]
        elif all(x and x[2].strip() for x in entries):
            out[m[1]] = {x[1]: scalar(x[2]) for x in entries}
        else:
            raise Refused("PX_E_4006")
    return out


def split_document(text: str) -> tuple[str, str]:
    """(frontmatter, body) of a claim document fenced by lines of three dashes."""
    parts = re.split(r"^---[^\S\n]*\n", text.replace("\r\n", "\n"), maxsplit=2, flags=re.M)
    if len(parts) < 3 or parts[0].strip():
        raise Refused("PX_E_4006")
    return parts[1], parts[2]


def emit_frontmatter(data: dict[str, object]) -> str:
    """Canonical text: fields by name, confidence with three places, supersedes sorted without repeats."""

    def text(v: object) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            plain = v == v.strip() and v and not re.search(r"[:#\n]", v) and v[0] not in "\"'[{&*!-~"
            try:
                plain = plain and scalar(v) == v
            except Refused:
                plain = False
            return v if plain else '"' + v + '"'
        return repr(v)

    lines = []
    for k in sorted(data):
        v = data[k]
        if k == "confidence" and isinstance(v, (int, float)) and not isinstance(v, bool):
            lines.append(f"{k}: {three_places(float(v))}")
        elif isinstance(v, list):
            v = sorted(set(v)) if k == "supersedes" and all(isinstance(x, str) for x in v) else v
            lines += [f"{k}: []"] if not v else [f"{k}:", *(f"  - {text(x)}" for x in v)]
        elif isinstance(v, dict):
            lines += [f"{k}: {{}}"] if not v else [f"{k}:", *(f"  {n}: {text(v[n])}" for n in sorted(v))]
        else:
            lines.append(f"{k}: {text(v)}")
    return "\n".join(lines) + "\n"


class _Written(str):
    """A scalar as it is written, with its kind."""

    kind: str


def _written(text: str) -> _Written:
    v = scalar(text)
    out = _Written(v if isinstance(v, str) else text.strip())
    out.kind = KINDS[type(v)]
    return out


DOCUMENT = f"code string, kind string, fields map<string,{PART}>, items array<{PART}>, body string"


def frontmatter(c: Column) -> Column:
    """struct<code, kind, fields, items, body> of claim documents: as ``canonical.shape``, fields in their order, numbers as they
    are written, lists and maps as JSON; and the text below. What is no document has code 4006; null gives nulls."""

    def part(v: object) -> dict:
        if isinstance(v, _Written):
            return {"kind": v.kind, "text": str(v)}
        return {"kind": KINDS[type(v)], "text": json.dumps(v, ensure_ascii=False)}

    @F.pandas_udf(DOCUMENT)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            try:
                head, body = split_document(x) if x is not None else ("", None)
                rows.append((None, None, None, None, None) if x is None else (None, "object", {k: part(v) for k, v in parse_frontmatter(head, _written).items()}, None, body))
            except Refused as e:
                rows.append((str(e), None, None, None, None))
        return pd.DataFrame(rows, columns=["code", "kind", "fields", "items", "body"])

    return run(c)


def canonical_document(c: Column) -> Column:
    """struct<text, changed, code> of claim documents: with canonical frontmatter, and whether that changed anything."""

    @F.pandas_udf("text string, changed boolean, code string")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            try:
                if x is None:
                    rows.append((None, None, None))
                    continue
                head, body = split_document(x)
                text = "---\n" + emit_frontmatter(parse_frontmatter(head)) + "---\n" + body
                rows.append((text, text != x, None))
            except Refused as e:
                rows.append((None, None, str(e)))
        return pd.DataFrame(rows, columns=["text", "changed", "code"])

    return run(c)


def migrated(manifests: DataFrame, legacy_field: str, spec_field: str, spec_version: str, legacy: tuple[str, ...] = ("1.0", "1.1"), target: str = "2.0") -> DataFrame:
    """(key, code, fields) of manifests (key, doc), doc as ``canonical.shape`` gives it, in the target version.

    Only objects of a legacy version are migrated: 1001 for other values, 3001 for other versions. The legacy field goes, at the
    top and in ``extensions``, and extensions that are empty without it; the spec field gets its version.
    """
    part = lambda f: F.try_element_at(F.col("doc.fields"), F.lit(f))
    text = lambda x: F.struct(F.lit("string").alias("kind"), F.lit(x).alias("text"))
    version, ext = part("format_version"), part("extensions")
    m = manifests.select("key", "doc", shape(F.when(ext["kind"] == "object", ext["text"]))["fields"].alias("inner"))
    code = F.coalesce("doc.code", F.when(F.col("doc.kind") != "object", "PX_E_1001"), F.when(~F.coalesce((version["kind"] == "string") & version["text"].isin(*legacy), F.lit(False)), "PX_E_3001"))
    m = m.withColumns({"code": code, "rest": F.map_filter("inner", lambda k, v: k != legacy_field)})
    value = lambda v: F.when(v["kind"] == "string", _quoted(v["text"])).otherwise(v["text"])
    entries = F.transform(F.array_sort(F.map_entries("rest"), lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)), lambda e: F.concat(_quoted(e["key"]), F.lit(": "), value(e["value"])))
    as_object = F.struct(F.lit("object").alias("kind"), F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}")).alias("text"))
    new = F.when((ext["kind"] == "object") & (F.size("rest") > 0), as_object).when(ext["kind"] != "object", ext)
    kept = F.map_filter(F.col("doc.fields"), lambda k, v: ~k.isin(legacy_field, "format_version", spec_field, "extensions"))
    added = F.map_filter(F.create_map(F.lit("format_version"), text(target), F.lit(spec_field), text(spec_version), F.lit("extensions"), new), lambda k, v: v.isNotNull())
    return m.select("key", "code", F.when(F.col("code").isNull(), F.map_concat(kept, added)).alias("fields"))


def _quoted(c: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)


@dataclass(frozen=True)
class Budget:
    """Limits of one archive."""

    files: int = 10_000
    total_bytes: int = 100 << 20
    file_bytes: int = 25 << 20
    ratio: int = 100
    path_length: int = 512


MEMBERS = "path string, ordinal int, name string, member string, type string, size bigint, content binary, code string"


def members(archive: bytes, budget: Budget = Budget()):
    """(ordinal, name, NFC name, type, declared size, content, code) per member, until a member goes beyond the budget: that one
    comes without content and is the last. An archive that cannot be read gives a row with code 4006."""
    total = 0
    try:
        tar = tarfile.open(fileobj=io.BytesIO(archive), mode="r:")
        for i, m in enumerate(tar):
            kind = "file" if m.isreg() else "folder" if m.isdir() else "other"
            over = i >= budget.files or m.size > budget.file_bytes or total + m.size > budget.total_bytes
            content = tar.extractfile(m).read() if kind == "file" and not over else None
            total += len(content or b"")
            yield i, m.name, unicodedata.normalize("NFC", m.name), kind, m.size, content, None
            if over or total > len(archive) * budget.ratio:
                return
    except (tarfile.TarError, EOFError):
        yield -1, None, None, None, None, None, "PX_E_4006"


def read_members(archives: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """(path, archive_bytes, ordinal, name, member, type, size, content, code): the members of archives (path, content) as they are."""

    def run(frames):
        for f in frames:
            rows = [(p, *m) for p, c in zip(f["path"], f["content"]) if c is not None for m in members(bytes(c), budget)]
            yield pd.DataFrame(rows, columns=["path", "ordinal", "name", "member", "type", "size", "content", "code"])

    sizes = archives.select("path", F.octet_length("content").alias("archive_bytes"))
    return archives.select("path", "content").mapInPandas(run, MEMBERS).join(sizes, "path")


def unpack(archives: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """(path, ordinal, member, is_dir, content, code) of archives (path, content), path being unique.

    The first member with a code ends its archive and has no content. Rules in their order: 6009 too many members, 6008 neither
    file nor folder, the path's own (``verification.path_rules``), 6007 there before, 6010 and 6011 declared sizes, 6013 more
    than declared, 6012 expands too far. Totals run along the members, at most ``Budget.files`` of an archive.
    """
    from ..operators.verification import path_code

    m = read_members(archives, budget)
    along = Window.partitionBy("path").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    m = m.withColumns({"_total": F.sum(size).over(along), "_seen": F.count("*").over(Window.partitionBy("path", "member").orderBy("ordinal"))})
    is_file, unsafe = F.col("type") == "file", path_code(F.col("member"), budget.path_length)
    code = (
        F.when(F.col("code").isNotNull(), F.col("code"))
        .when(F.col("ordinal") >= budget.files, "PX_E_6009")
        .when(F.col("type") == "other", "PX_E_6008")
        .when(unsafe.isNotNull(), unsafe)
        .when(F.col("_seen") > 1, "PX_E_6007")
        .when(is_file & (F.col("size") > budget.file_bytes), "PX_E_6010")
        .when(is_file & (F.col("_total") - size + F.col("size") > budget.total_bytes), "PX_E_6011")
        .when(is_file & ((size > budget.file_bytes) | (F.col("_total") > budget.total_bytes)), "PX_E_6013")
        .when(is_file & (F.col("_total") > F.col("archive_bytes") * budget.ratio), "PX_E_6012")
    )
    m = m.withColumn("code", code)
    m = m.withColumn("_end", F.min(F.when(F.col("code").isNotNull(), F.col("ordinal"))).over(Window.partitionBy("path")))
    m = m.filter("_end IS NULL OR ordinal <= _end")
    return m.select("path", F.greatest("ordinal", F.lit(0)).alias("ordinal"), "member", (F.col("type") == "folder").alias("is_dir"), F.when(F.col("code").isNull(), F.col("content")).alias("content"), "code")


def pack_members(files: list[tuple[str, bytes | None]]) -> bytes:
    """A canonical ustar archive: members by NFC path, fixed owner, mode and time. Null content is a folder."""
    named = sorted((unicodedata.normalize("NFC", p), c) for p, c in files)
    if sum(len(c or b"") for _, c in named) > Budget.total_bytes or len(named) > Budget.files:
        raise Refused("PX_E_6011")
    if len({p for p, _ in named}) < len(named):
        raise Refused("PX_E_6007")
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for p, c in named:
            info = tarfile.TarInfo(p)
            info.type, info.mode, info.size = (tarfile.DIRTYPE, 0o755, 0) if c is None else (tarfile.REGTYPE, 0o644, len(c))
            tar.addfile(info, io.BytesIO(c or b""))
    return out.getvalue()


def pack(rows: DataFrame, package: str = "package", path: str = "path", content: str = "content") -> DataFrame:
    """(package, archive): one archive per package, written in one task; a package beyond ``Budget.total_bytes`` is refused."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        files = [(p, None if c is None else bytes(c)) for p, c in zip(f[path], f[content])]
        return pd.DataFrame({package: f[package].iloc[:1], "archive": [pack_members(files)]})

    return rows.groupBy(package).applyInPandas(run, f"{package} {rows.select(package).dtypes[0][1]}, archive binary")


def _canonical_source(files: dict[str, bytes]) -> list[tuple[str, bytes]]:
    """The members of a package from its source: claims' digests taken from their files, documents in canonical JSON, and nothing
    that the manifest does not name but a notice."""
    if "manifest.json" not in files or "provenance.jsonl" not in files:
        raise Refused("PX_E_2005")
    manifest = load_strict(files["manifest.json"])
    out = {}
    for claim in manifest["claims"]:
        if claim["path"] not in files:
            raise Refused("PX_E_5002")
        out[claim["path"]] = files[claim["path"]]
        claim["hash"] = hashlib.sha256(files[claim["path"]]).hexdigest()
    out["manifest.json"] = canonical_text(manifest).encode()
    out["provenance.jsonl"] = b"".join(canonical_text(load_strict(x)).encode() for x in files["provenance.jsonl"].splitlines() if x.strip())
    if "NOTICE" in files:
        out["NOTICE"] = files["NOTICE"]
    return list(out.items())


def pack_sources(rows: DataFrame) -> DataFrame:
    """(package, archive, code) of package sources (package, path, content), whose documents are valid: the canonical archive, with
    the claims' digests computed anew, or the code of what keeps it from being packed. A package is written in one task."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        archive = code = None
        try:
            archive = pack_members(_canonical_source({p: bytes(c) for p, c in zip(f["path"], f["content"]) if c is not None}))
        except Refused as e:
            code = str(e)
        except (KeyError, TypeError):
            code = "PX_E_1001"
        return pd.DataFrame({"package": f["package"].iloc[:1], "archive": [archive], "code": [code]})

    return rows.select("package", "path", "content").groupBy("package").applyInPandas(run, f"package {rows.select('package').dtypes[0][1]}, archive binary, code string")
