"""Columns without what looks like a credential: for logs, for digests, and for paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How issued tokens begin, and the fewest characters that follow.
ISSUED = {
    "ghp_": 30, "gho_": 30, "ghu_": 30, "ghs_": 30, "ghr_": 30, "github_pat_": 40, "sk-": 20, "AKIA": 16, "ASIA": 16, "xoxa-": 10, "xoxb-": 10,
    "xoxp-": 10, "xoxr-": 10, "xoxs-": 10, "sk_live_": 16, "rk_live_": 16, "SG.": 33,
}
#: Words in a field's name that tell of a credential, and ends of names that don't.
TELLING, HARMLESS = ("token", "secret", "password", "passwd", "apikey", "authorization", "credential", "privatekey"), ("type", "fingerprint", "count", "id")
GONE, GONE_DIGEST = "[REDACTED]", "[redacted]"


def _without_keys(text: Column) -> Column:
    """Text without private keys: each goes from its BEGIN to the next END, or, where that is cut off, over the lines of its body.

    Texts are cut at the BEGIN marks, so the work is in proportion to their length.
    """
    head, *rest = (lambda parts: (F.get(parts, F.lit(0)), F.slice(parts, F.lit(2), F.size(parts))))(F.split(text, r"-----BEGIN (?=[A-Z ]{0,32}PRIVATE KEY)", -1))
    gap = r"(?:[ \t\r]|\\[rt])*+"
    header, line = r"(?:Proc-Type|DEK-Info|Version|Comment|Charset): [^\n\\]*+", r"(?:[A-Za-z0-9+/]{16,}+=*+|[A-Za-z0-9+/]*+={1,2}+|)"
    body = rf"^[A-Z ]{{0,32}}PRIVATE KEY(?: BLOCK)?-----(?:{gap}(?=\n|\\n|$))?+(?>(?:\n|\\n){gap}(?:{header}|{line}){gap}(?=\n|\\n|$|[\"']))*+"
    ended = F.transform(rest[0], lambda p: F.concat(F.lit(GONE), F.when(p.rlike(r"-----END [A-Z ]{0,32}PRIVATE KEY"), F.regexp_replace(p, r"^[\s\S]*?-----END [A-Z ]{0,32}PRIVATE KEY(?: BLOCK)?-----", "")).otherwise(F.regexp_replace(p, body, ""))))
    return F.concat(head, F.array_join(ended, ""))


def scrub_log(text: Column) -> Column:
    """Text without tokens, values of authorization and private keys, ended or cut off."""
    out = F.regexp_replace(_without_keys(text), r"(?i)(authorization\W{1,12})(?:(?:basic|bearer|token)\s+[^\s\"',]++|[^\s\"',]{16,}+)", f"$1{GONE}")
    issued = "|".join(f"{begin.replace('.', chr(92) + '.')}[A-Za-z0-9_.-]{{{least},}}+" for begin, least in ISSUED.items())
    return F.regexp_replace(out, rf"(?<![A-Za-z0-9_])(?:{issued})", GONE)


def sensitive_key(name: Column) -> Column:
    """Whether a field's name tells that its value is a credential."""
    bare = F.lower(F.regexp_replace(name, "[_-]", ""))
    some = lambda test, words: reduce(lambda a, b: a | b, (test(bare, F.lit(w)) for w in words))
    return some(F.contains, TELLING) & ~some(F.endswith, HARMLESS)


def scrub_map(values: Column) -> Column:
    """map<string, string> with sensitive values gone and the others scrubbed."""
    return F.transform_values(values, lambda k, v: F.when(sensitive_key(k), GONE).otherwise(scrub_log(v)))


def _tells(name: str) -> bool:
    bare = name.replace("_", "").replace("-", "").lower()
    return any(w in bare for w in TELLING) and not bare.endswith(HARMLESS)


def scrub_deep(value: Column, kind: T.DataType) -> Column:
    """A value of any type with all strings in it scrubbed, however deep; what a sensitive name holds is gone (null where it isn't a string)."""
    if isinstance(kind, T.StringType):
        return scrub_log(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: scrub_deep(x, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        gone = F.lit(GONE if isinstance(kind.valueType, T.StringType) else None).cast(kind.valueType)
        return F.transform_values(value, lambda k, v: F.when(sensitive_key(k) & v.isNotNull(), gone).otherwise(scrub_deep(v, kind.valueType)))
    if isinstance(kind, T.StructType):
        held = lambda f: F.when(value[f.name].isNotNull(), F.lit(GONE if isinstance(f.dataType, T.StringType) else None).cast(f.dataType))
        fields = [(held(f) if _tells(f.name) else scrub_deep(value[f.name], f.dataType)).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def scrub_tokens(text: Column) -> Column:
    """Text without anything that has a token's shape: runs of 24 characters, or of 16 with letters and digits."""
    runs = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_+/=.-]+|[^A-Za-z0-9_+/=.-]+"), F.lit(0))
    inner = lambda r: F.regexp_extract(r, r"[A-Za-z0-9_+=-]{16,}", 0)  # noqa: E731  at most one in a run of under 24
    mixed = lambda s: s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    clean = lambda r: F.when(r.rlike("^[A-Za-z0-9_+/=.-]{24}"), GONE_DIGEST).when(mixed(inner(r)), F.replace(r, inner(r), F.lit(GONE_DIGEST))).otherwise(r)
    return F.array_join(F.transform(runs, clean), "")


def clipped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def scrub_text(text: Column, most: int) -> Column:
    """A digest's text: no inline code, no tokens, single spaces, at most ``most`` characters."""
    return clipped(F.trim(F.regexp_replace(scrub_tokens(F.regexp_replace(text, r"`{1,3}[^`]*`{1,3}", "[code]")), r"\s+", " ")), most)


def scrub_path(path: Column, most: int = 200) -> Column:
    """A path, part by part."""
    return clipped(F.array_join(F.transform(F.split(path, "/"), lambda s: F.when(F.length(s) >= 24, GONE_DIGEST).otherwise(scrub_tokens(s))), "/"), most)
