"""Scalar functions as expressions over built-ins."""

from __future__ import annotations

from functools import reduce

import base64
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .validity import col, is_finite, valid

_UINT32_MAX = 4294967295


def uid64(c) -> Column:
    """The first eight bytes of the md5 as a little-endian signed number, as a string."""
    digest = F.md5(col(c).cast("binary"))
    pairs = F.concat(*[F.substring(digest, 15 - 2 * i, 2) for i in range(8)])
    unsigned = F.conv(pairs, 16, 10).cast("decimal(20,0)")
    wrap = F.lit(str(2**64)).cast("decimal(20,0)")
    signed = F.when(unsigned >= F.lit(str(2**63)).cast("decimal(20,0)"), unsigned - wrap).otherwise(unsigned)
    return signed.cast("decimal(20,0)").cast("string")


def is_uint32(c) -> Column:
    """One to ten digits whose value fits 32 bits; NULL gives NULL."""
    c = col(c)
    return F.when(c.isNotNull(), c.rlike("^[0-9]{1,10}$") & F.coalesce(c.try_cast("bigint") <= F.lit(_UINT32_MAX), F.lit(False)))


def map_join(m, entry_sep: str = ",", kv_sep: str = ":") -> Column:
    """``key<kv_sep>value`` of each entry in map order; an invalid value prints ``null``."""
    text = lambda e: F.concat(e["key"].cast("string"), F.lit(kv_sep), F.coalesce(F.when(is_finite(e["value"]), e["value"].cast("string")), F.lit("null")))
    return F.array_join(F.transform(F.map_entries(col(m)), text), entry_sep)


def map_values_ordered(m, keys) -> Column:
    """The map's values for the given keys; NULL where missing or invalid."""
    m = col(m)
    keys = F.array(*map(F.lit, keys)) if isinstance(keys, (list, tuple)) else col(keys)
    return F.transform(keys, lambda k: F.when(is_finite(F.try_element_at(m, k)), F.try_element_at(m, k)))


def uuid_format(c, upper: bool = False) -> Column:
    """32 hexadecimal digits as 8-4-4-4-12, NULL for anything else."""
    cased = (F.upper if upper else F.lower)(col(c))
    digits = "[0-9A-F]" if upper else "[0-9a-f]"
    return F.when(cased.rlike(f"^{digits}{{32}}$"), F.regexp_replace(cased, f"^({digits}{{8}})({digits}{{4}})({digits}{{4}})({digits}{{4}})({digits}{{12}})$", "$1-$2-$3-$4-$5"))


#: Kind and prefix of each id type (fixed values; pass another table where types are named differently).
UID_TYPES = {
    "UID": ("dec", ""),
    "T1ID": ("dec", "t1:"),
    "T2ID": ("dec", "t2:"),
    "T3ID": ("hex", "t3:"),
    "GAID": ("uuid_lower", "gaid:"),
    "IDFA": ("uuid_upper", "idfa:"),
    "EMAIL": ("email", "email:"),
    "MAIL": ("email", "email:"),
}


def uid2user(uid, uid_type, types: dict[str, tuple[str, str]] = UID_TYPES) -> Column:
    """``prefix + id`` if the id is well-formed for its type, else NULL."""
    uid, uid_type = col(uid), col(uid_type)
    long_max = 2**63 - 1
    as_decimal = lambda c: c.try_cast("decimal(20,0)")
    forms = {
        "dec": F.when(uid.rlike("^[+-]?[0-9]{1,19}$") & uid.try_cast("bigint").isNotNull(), uid.try_cast("bigint").cast("string")),
        "hex": F.when(uid.rlike("^[0-9A-Fa-f]{1,16}$") & (as_decimal(F.conv(uid, 16, 10)) <= F.lit(str(long_max)).cast("decimal(20,0)")), F.conv(uid, 16, 10)),
        "uuid_lower": uuid_format(uid),
        "uuid_upper": uuid_format(uid, upper=True),
        "email": F.when(uid.rlike(r"^[^@]+@[^@]*[^@.][.][^@.][^@]*$"), uid),
    }
    out = F.lit(None).cast("string")
    for name, (kind, prefix) in types.items():
        out = F.when(uid_type == name, F.concat(F.lit(prefix), forms[kind])).otherwise(out)
    return out


def combine(*columns, kind: str) -> Column:
    """Two or more lists, one after the other, or maps, the last value of a key wins; NULL parts are skipped.

    All parts NULL give NULL.
    """
    if len(columns) < 2:
        raise ValueError("combine needs at least two columns")
    cols = [col(c) for c in columns]
    if kind == "list":
        return F.when(F.coalesce(*cols).isNotNull(), F.concat(*[F.coalesce(c, F.array()) for c in cols]))
    return F.when(F.coalesce(*cols).isNotNull(), merge_maps(*[F.coalesce(c, F.map_from_arrays(F.array(), F.array())) for c in cols]))


def merge_maps(first, *others) -> Column:
    """The entries of all maps; of a key that several have, the last value. Needs no setting of the session."""

    def over(m, later):
        return F.map_concat(F.map_filter(m, lambda k, v: ~F.map_contains_key(later, k)), later)

    return reduce(over, map(col, others), col(first))


def scale(score, lo, hi, low: float, high: float, reverse: bool = False) -> Column:
    """The score's place between ``lo`` and ``hi``, spread over ``low`` to ``high`` and rounded; no spread counts as the top."""
    rev = 1.0 if reverse else 0.0
    share = F.coalesce(F.try_divide(col(score) - col(lo), col(hi) - col(lo)), F.lit(1.0))
    return F.round(F.lit(low) + F.lit(high - low) * (F.lit(rev) + F.lit(1 - 2 * rev) * share), 0).cast("int")


def map_topk(m, k: int) -> Column:
    """The k entries with the largest values; of equal values those with larger keys."""
    pairs = F.transform(F.map_entries(col(m)), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k")))
    kept = F.slice(F.reverse(F.array_sort(pairs)), 1, k)
    return F.map_from_entries(F.transform(kept, lambda p: F.struct(p["k"], p["v"])))


def array_firstk(a, k: int) -> Column:
    return F.slice(col(a), 1, k)


def drop_null_values(m) -> Column:
    return F.map_filter(col(m), lambda k, v: v.isNotNull())


def nan_inf_to_null(c, kind: str) -> Column:
    """Invalid numbers to NULL in a scalar, an array or the values of a map."""
    c = col(c)
    keep = lambda x: F.when(is_finite(x), x)
    if kind == "array":
        return F.transform(c, keep)
    if kind == "map":
        return F.transform_values(c, lambda k, v: keep(v))
    return keep(c)


def almost_equal(a, b, eps: float = 1e-5) -> Column:
    """Equal up to a relative difference; NULL equals NULL and NaN equals NaN, infinities equal themselves."""
    a, b = col(a).cast("double"), col(b).cast("double")
    both = is_finite(a) & is_finite(b)
    near = F.abs(a - b) <= F.lit(eps) * F.greatest(F.abs(a), F.abs(b), F.lit(1e-300))
    return F.when(both, near).otherwise(a.eqNullSafe(b))


# String helpers of the driver


def slugify(text: str) -> str:
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    return re.sub(r"[-\s]+", "-", re.sub(r"[^\w\s-]", "", plain).strip().lower())


def split_trim(text: str, sep: str = ",") -> list[str]:
    return [p.strip() for p in text.split(sep) if p.strip()]


def parse_map(text: str, sep: str = ",", kv_sep: str = "=") -> dict[str, str]:
    pairs = (p.split(kv_sep, 1) for p in split_trim(text, sep))
    return {k.strip(): v.strip() for k, v in pairs}


def b64_encode(text: str) -> str:
    return base64.b64encode(text.encode()).decode()


def b64_decode(text: str) -> str:
    return base64.b64decode(text).decode()


__all__ = [n for n in dir() if not n.startswith("_")] + ["valid"]
