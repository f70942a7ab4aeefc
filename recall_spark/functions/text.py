"""Column functions on texts."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point ranges that count as CJK, and token weights.
CJK_BASIC = r"[一-鿿㐀-䶿　-〿぀-ヿ가-힯＀-￯]"
CJK_EXTRA = r"[\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}]"
BEYOND = r"[\x{10000}-\x{10FFFF}]"
WEIGHT_CJK, WEIGHT_BEYOND, WEIGHT_OTHER = 1.5, 2.0, 0.25
WORDS = r"[\p{L}\p{N}]+"


def identity_hash(role: str | Column, content: str | Column) -> Column:
    """SHA-256 of role, a zero byte and content, as lower-case hex."""
    return F.sha2(F.concat(F.encode(role, "UTF-8"), F.unhex(F.lit("00")), F.encode(content, "UTF-8")), 256)


def estimate_tokens(text: str | Column) -> Column:
    """Weighted code points, rounded up. Texts of common characters take one length and no pattern runs twice."""
    n = F.length(text)
    cjk = F.regexp_count(text, F.lit(CJK_BASIC)) + F.regexp_count(text, F.lit(CJK_EXTRA))
    beyond = F.regexp_count(text, F.lit(BEYOND)) - F.regexp_count(text, F.lit(CJK_EXTRA))
    return F.ceil(cjk * WEIGHT_CJK + beyond * WEIGHT_BEYOND + (n - cjk - beyond) * WEIGHT_OTHER).cast("long")


def has_cjk(text: str | Column) -> Column:
    return F.col(text).rlike(CJK_BASIC) | F.col(text).rlike(CJK_EXTRA) if isinstance(text, str) else text.rlike(CJK_BASIC) | text.rlike(CJK_EXTRA)


def words(text: str | Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def db_role(role: str | Column) -> Column:
    role = F.col(role) if isinstance(role, str) else role
    return F.when(role.isin("tool", "toolResult"), "tool").when(role.isin("system", "user"), role).otherwise("assistant")


def snippet(text: str, terms: list[str]) -> Column:
    """24 characters before and 40 behind the earliest term, with dots where the text goes on; else the first 80 characters."""
    found = [(F.instr(F.lower(text), t), len(t)) for t in terms]
    first = F.least(*[F.when(p > 0, p) for p, _ in found], F.lit(None).cast("int"))
    size = F.coalesce(*[F.when(p == first, F.lit(max(n, 1))) for p, n in found])
    start, end = F.greatest(F.lit(1), first - 24), F.least(F.length(text), first - 1 + size + 40)
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.trim(F.substring(F.col(text), start, end - start + 1)), F.when(end < F.length(text), "...").otherwise(""))
    head = F.trim(text)
    return F.when(first.isNotNull(), cut).otherwise(F.when(F.length(head) <= 80, head).otherwise(F.concat(F.rtrim(F.substring(head, 1, 77)), F.lit("..."))))


def cosine_from_l2(distance: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1.0 - distance * distance / 2.0))


def band(cosine: Column) -> Column:
    # Least cosine of each band.
    return F.when(cosine >= 0.65, "high").when(cosine >= 0.50, "medium").when(cosine >= 0.35, "low").otherwise("noise")


def truncate_to_tokens(text: str, tokens: int) -> Column:
    """The longest start of a text that is estimated at no more than so many tokens; nothing for a limit of 0 or less.

    No character weighs less than a quarter token, so only the first 4 * tokens characters are looked at: texts of common
    characters end there, in others a prefix sum over weights finds the end.
    """
    if tokens <= 0:
        return F.when(F.col(text).isNotNull(), "")

    @F.pandas_udf("int")
    def fits(heads: pd.Series) -> pd.Series:
        def length(s: str | None) -> int:
            points = np.frombuffer((s or "").encode("utf-32-le"), np.uint32)
            cjk = np.zeros(len(points), bool)
            for low, high in _CJK_POINTS:
                cjk |= (points >= low) & (points <= high)
            weights = np.where(cjk, WEIGHT_CJK, np.where(points >= 0x10000, WEIGHT_BEYOND, WEIGHT_OTHER))
            return int(np.searchsorted(np.ceil(np.cumsum(weights)), tokens, "right"))

        return heads.map(length).astype("int32")

    head = F.substring(text, 1, 4 * tokens)
    return F.when(head.rlike(CJK_BASIC) | head.rlike(BEYOND), F.substring(head, F.lit(1), fits(head))).otherwise(head)


#: The code points of CJK_BASIC and CJK_EXTRA.
_CJK_POINTS = [(ord(m[1]), ord(m[2])) for m in re.finditer("(.)-(.)", CJK_BASIC)] + [(int(m[1], 16), int(m[2], 16)) for m in re.finditer(r"\\x\{(\w+)\}-\\x\{(\w+)\}", CJK_EXTRA)]
