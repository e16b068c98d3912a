"""Column functions: cleaning, parsing, names, addresses, dates."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CLASS_LABELS, LABEL2ID

# Texts that stand for a missing value.
MISSING = ["", "-", "nan", "NaN", "None", "null"]


def clean_value(col):
    """Trim, null the missing-value markers, double quotes to single, newlines to spaces."""
    t = F.trim(col.cast("string"), F.lit(" \t\n\r\x0b\x0c"))
    return F.when(~t.isin(MISSING), F.translate(t, '"\n', "' "))


def safe_number(col):
    """A finite double, or null."""
    x = clean_value(col).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


@F.pandas_udf(T.StringType())
def _literal_to_json(cells: pd.Series) -> pd.Series:
    def one(s):
        if not isinstance(s, str) or not s:
            return None
        for parse in (json.loads, ast.literal_eval):
            try:
                v = parse(s)
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                continue
            return json.dumps(v, ensure_ascii=False) if isinstance(v, dict | list) else None
        return None

    return cells.map(one)


def literal_to_json(col):
    """A JSON or Python literal cell as JSON text; anything but an object or list is null.

    Cells that are JSON already, or JSON but for single quotes, are settled in
    the JVM by :func:`parse_struct`; this is the slow path for the rest.
    """
    return _literal_to_json(col)


def parse_struct(col, schema: str):
    """``from_json`` that also accepts single quotes."""
    return F.from_json(col, schema, {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})


def compact_json(fields: dict[str, object], event: str):
    """JSON of the non-null ``fields`` (in order) inside ``{event: ...}`` without blanks."""
    return F.to_json(F.struct(F.struct(*[v.alias(k) for k, v in fields.items()]).alias(event)))


def char_ratios(col):
    """Shares of vowels, digits and other special characters of a name, to 4 digits; 0 for an empty name."""
    n = F.length(col)
    share = lambda pattern: F.when(n > 0, F.round(F.regexp_count(col, F.lit(pattern)) / n, 4)).otherwise(0.0)
    return {"cn_vowel_ratio": share("[aeiouAEIOU]"), "cn_digit_density": share("[0-9]"), "cn_special_char_density": share("[^\\p{L}\\p{N}]")}


def name_hash(col, buckets: int = 1024):
    """MD5 of the name modulo a power of two up to 4096."""
    return F.conv(F.right(F.md5(col.cast("binary")), F.lit(3)), 16, 10).cast("int") % buckets


def entropy_bits(col):
    """Shannon entropy of the characters of a text, in bits."""
    n = F.length(col)
    letters = F.array_distinct(F.split(col, ""))
    letters = F.filter(letters, lambda c: c != "")
    share = lambda c: (n - F.length(F.replace(col, c, F.lit("")))) / n
    return F.when(n > 0, -F.aggregate(letters, F.lit(0.0), lambda s, c: s + share(c) * F.log2(share(c)))).otherwise(0.0)


def name_features(col):
    """Length, sub-domain count, address test, entropy, www prefix, digit share and hyphen test of a host name."""
    cn = F.coalesce(col, F.lit(""))
    bare = F.regexp_replace(cn, r"\.$", "")
    return {
        "cn_len": F.length(cn),
        "cn_subdomain_count": F.greatest(F.lit(0), F.size(F.split(bare, r"\.")) - 1),
        "cn_has_ip": cn.rlike(r"^(\d{1,3}\.){3}\d{1,3}$").cast("int"),
        "cn_entropy": F.round(entropy_bits(cn), 6),
        "cn_is_www": cn.startswith("www.").cast("int"),
        "cn_digit_ratio": F.round(F.regexp_count(cn, F.lit("[0-9]")) / F.greatest(F.length(cn), F.lit(1)), 6),
        "cn_has_hyphen": cn.contains("-").cast("int"),
    }


def top_level(col):
    return F.lower(F.element_at(F.split(F.coalesce(col, F.lit("")), r"\."), -1))


def label_id(col):
    """Class id of a numeric or named label; an unknown name is an error, null stays null."""
    name = F.lower(F.trim(col.cast("string")))
    pairs = F.create_map(*[F.lit(x) for kv in LABEL2ID.items() for x in kv])
    known = F.coalesce(name.try_cast("double").cast("int"), F.element_at(pairs, name))
    return F.when(name.isNull(), None).when(known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), name)).cast("int"))


def label_name(col):
    return F.get(F.array(*[F.lit(x) for x in CLASS_LABELS]), col.cast("int"))


def ip_to_long(col):
    """Dotted IPv4 as a number; anything else is 0."""
    part = lambda i: F.get(F.split(col, r"\."), i).try_cast("long")
    ok = col.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    return F.when(ok, part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3)).otherwise(F.lit(0).cast("long"))


def long_to_ip(col):
    byte = lambda n: F.shiftright(col, n).bitwiseAND(255).cast("string")
    return F.concat_ws(".", byte(24), byte(16), byte(8), byte(0))


def swap_bytes(col):
    """A 32-bit number with its bytes reversed."""
    byte = lambda n: F.shiftright(col, n).bitwiseAND(255)
    return byte(0) * 16777216 + byte(8) * 65536 + byte(16) * 256 + byte(24)


def flow_uid(src_ip, src_port, dst_ip, dst_port, first_ts):
    return F.concat_ws("_", src_ip, src_port.cast("string"), dst_ip, dst_port.cast("string"), first_ts.cast("string"))


def canonical_uid(uid, src_ip, src_port, dst_ip, dst_port, proto, ts):
    """The given uid if it holds a value, else one made of the 5-tuple and the time."""
    made = F.concat_ws("_", src_ip, src_port.cast("int").cast("string"), dst_ip, dst_port.cast("int").cast("string"), F.lower(proto), ts.cast("string"))
    return F.when(clean_value(uid).isNotNull(), uid).otherwise(made)


def days_between(later, earlier):
    """Days to 4 digits, or -1 where ``later`` does not follow ``earlier``."""
    return F.when(later > earlier, F.round((later - earlier) / 86400.0, 4)).otherwise(-1.0)


# Date forms of the two data sets.
DAY_FIRST = ["d/M/yyyy H:m:s", "d/M/yyyy h:m:s a", "d/M/yyyy H:m"]
YEAR_FIRST = ["yyyy-M-d H:m:s", "yyyy/M/d H:m:s", "yyyy-M-d h:m:s a", "yyyy/M/d h:m:s a", "yyyy/M/d H:m"]


def parse_epoch(col, formats, offset_hours: float = 0):
    """Seconds since 1970 of a local time with a fixed offset; failures and negatives are 0."""
    text = F.regexp_replace(F.regexp_replace(F.trim(col), "上午", "AM"), "下午", "PM")
    text = F.regexp_replace(text, r"(AM|PM)\s*(\d{1,2}:\d{1,2}(:\d{1,2})?)", "$2 $1")
    found = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
    return F.greatest(F.lit(0), F.coalesce(F.unix_timestamp(found) - int(offset_hours * 3600), F.lit(0))).cast("long")


def parse_array(col, kind: str = "array<double>"):
    """Array of a JSON text; anything else is an empty array."""
    return F.coalesce(F.from_json(col, kind), F.array().cast(kind))


def array_steps(col):
    """Differences of neighbours, negative ones left out."""
    n = F.size(col)
    d = F.zip_with(F.slice(col, 2, F.greatest(n - 1, F.lit(0))), F.slice(col, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)
    return F.filter(d, lambda x: x >= 0)


def risk_level(score):
    return F.when(score >= 85, "critical").when(score >= 60, "high").when(score >= 30, "medium").otherwise("low")


def progress_ratio(line):
    """``n/m`` in a line of text as a ratio, null without one or with m = 0."""
    n, m = (F.regexp_extract(line, r"(\d+)\s*/\s*(\d+)", i).try_cast("double") for i in (1, 2))
    return F.when(m > 0, n / m)


# Columns of a connection list by words their names hold.
COLUMN_WORDS = {"src_ip": ("source ip", "src ip"), "dst_ip": ("destination ip", "dst ip"), "src_port": ("source port", "src port"), "dst_port": ("destination port", "dst port"), "timestamp": ("timestamp", "time")}


def standard_names(columns: list[str]) -> dict[str, str]:
    """Columns of a connection list by meaning: the first whose cleaned name holds one of the words."""
    clean = {c: " ".join(c.replace("﻿", "").replace("_", " ").lower().split()) for c in columns}
    found: dict[str, str] = {}
    for want, words in COLUMN_WORDS.items():
        hit = next((c for w in words for c in columns if w in clean[c] and c not in found), None)
        if hit is not None:
            found[hit] = want
    return found
