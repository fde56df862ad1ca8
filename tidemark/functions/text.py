"""Validators, key builders and parsers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of ids, stamps and keys (fixed values).
ID = r"^[A-Za-z0-9_-]{1,128}$"
NODE_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z$"
SHA256 = r"^[0-9a-f]{64}$"


def valid_id(x: Column) -> Column:
    return F.coalesce(x.rlike(ID), F.lit(False))


def valid_node_id(x: Column) -> Column:
    return F.coalesce(x.rlike(NODE_ID), F.lit(False))


def valid_object_name(x: Column) -> Column:
    """No leading slash, backslash or control character, and no empty, ``.`` or ``..`` part."""
    parts = F.split(x, "/")
    return F.coalesce((x != "") & ~x.startswith("/") & ~x.contains("\\") & ~x.rlike(r"[\x00-\x1f\x7f]") & ~F.exists(parts, lambda p: p.isin("", ".", "..")), F.lit(False))


def manifest_name(x: Column) -> Column:
    """``latest`` or a stamp, with or without ``.json``; null for anything else."""
    name = F.regexp_replace(x, r"\.json$", "")
    return F.when((name == "latest") | name.rlike(STAMP), name)


def valid_ref(size: Column, sha: Column, least: int, most: int) -> Column:
    """Whether a size lies in [least, most] and a digest is 64 lower-case hex characters."""
    return F.coalesce(size.between(least, most) & sha.rlike(SHA256), F.lit(False))


def path_parts(path: Column) -> Column:
    """Parts of a path without empty and ``.`` parts; null if one is ``..``."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    return F.when(~F.array_contains(parts, ".."), parts)


def sanitize(x: Column, most: int = 32, empty: str = "node") -> Column:
    """Characters outside A-Z a-z 0-9 - _ become _, cut to ``most``; an empty text becomes ``empty``."""
    out = F.substring(F.regexp_replace(x, r"[^A-Za-z0-9_-]", "_"), 1, most)
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(empty))


def terminal_safe(x: Column) -> Column:
    """Control characters become ``?``."""
    return F.regexp_replace(x, r"[\x00-\x1f\x7f-\x9f]", "?")


def chunk_id(writer: Column, epoch: Column, counter: Column) -> Column:
    return F.concat_ws("-", writer, epoch.cast("string"), counter.cast("string"))


def chunk_path(root: Column, name: Column) -> Column:
    return F.concat(root, F.lit("/"), name, F.lit(".chunk"))


def manifest_key(node: Column, stamp: Column) -> Column:
    return F.concat(F.lit("manifests/"), node, F.lit("/"), stamp, F.lit(".json"))


def manifest_key_node(key: Column) -> Column:
    """Node of a manifest key, null for other keys."""
    return F.nullif(F.regexp_extract(key, r"^manifests/([^/]+)/[^/]+\.json$", 1), F.lit(""))


def manifest_key_name(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, r"^manifests/[^/]+/([^/]+)\.json$", 1), F.lit(""))


def chunk_id_from_key(key: Column) -> Column:
    """Chunk id of an object key ``chunks/<id>``, null if the id is not valid."""
    return F.nullif(F.regexp_extract(key, r"^chunks/([A-Za-z0-9_-]{1,128})$", 1), F.lit(""))


def volume_file_name(volume: Column) -> Column:
    """base64url without padding."""
    return F.translate(F.base64(F.encode(volume, "UTF-8")), "+/=\r\n", "-_")


def volume_from_file_name(name: Column) -> Column:
    padded = F.rpad(F.translate(name, "-_", "+/"), F.ceil(F.length(name) / 4).cast("int") * 4, "=")
    return F.decode(F.unbase64(padded), "UTF-8")


def relative_name(prefix: Column, key: Column) -> Column:
    """Key without its prefix; null if it has another."""
    return F.when(F.startswith(key, prefix), F.substring(key, F.length(prefix) + 1, F.length(key)))


def redact_target(url: Column) -> Column:
    """URL without user info, query, fragment and ``;`` parameters."""
    cut = F.regexp_replace(url, r"[?#;].*$", "")
    return F.regexp_replace(cut, r"^([a-z0-9+.-]+://)[^/@]*@", "$1")


def parse_size(x: Column) -> Column:
    """``10G`` to bytes: K, M, G or T of 1024; null for other texts and overflow."""
    n = F.regexp_extract(x, r"^([0-9]{1,18})([KMGT]?)$", 1)
    unit = F.regexp_extract(x, r"^([0-9]{1,18})([KMGT]?)$", 2)
    power = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).when(unit == "T", 1 << 40).otherwise(1).cast("long")
    return F.when(n != "", F.try_multiply(n.cast("long"), power))


def parse_byte_size(x: Column) -> Column:
    """``10Gi`` or ``10G``, trimmed; an empty text is 0."""
    t = F.trim(x)
    return F.when(t == "", F.lit(0).cast("long")).otherwise(parse_size(F.regexp_replace(t, r"^([0-9]+[KMGT])i$", "$1")))


def parse_seeds(x: Column) -> Column:
    """Comma-separated list, trimmed, without empty entries."""
    return F.filter(F.transform(F.split(x, ","), lambda s: F.trim(s)), lambda s: s != "")


def parse_int64(x: Column) -> Column:
    """Decimal text to BIGINT, null for anything else (64-bit numbers travel as JSON strings)."""
    return F.when(x.rlike(r"^-?[0-9]+$"), x.try_cast("bigint"))


def labels_text(labels: Column) -> Column:
    """``{k="v",...}`` of an array of (name, value) structs; empty for no labels."""
    quoted = F.transform(labels, lambda l: F.concat(l["name"], F.lit('="'), F.replace(F.replace(l["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.when(F.size(labels) > 0, F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))).otherwise("")
