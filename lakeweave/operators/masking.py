"""Secrets, identifiers and places in free text replaced by typed marks, and nothing else changed.

The rules are applied in their order, the wider before those for what stands inside them. Where
a rule could try the same run of characters from every place in it, it begins at the run's
first place only, so a text costs its length.

Defined results: null gives null; marks that stand in a text already stay as they are.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The kinds of what is masked, with the patterns that find it, in order.
RULES = (
    (r"\1<URL>", r"(?<![a-zA-Z0-9+.-])(?=[a-zA-Z0-9+.-]*://\S+)([a-zA-Z0-9+.-]*?)\b[a-zA-Z][a-zA-Z0-9+.-]*://\S+"),
    (r"\1<EMAIL>", r"(?<![\w.+-])([.+-]*+)\w[\w.+-]*+@[\w-]+(?:\.[\w-]+)*\b"),
    (r"<TOKEN>", r"(?i)\bauthorization\s*:\s*(?:(?:basic|bearer|digest|token)\s+)?\S+"),
    (r"<TOKEN>", r"(?i)\bbearer\s+\S+"),
    (r"\1<TOKEN>", r"(?<![\w-])(?=[\w-]+\.[\w-]+\.[\w-]+)([\w-]*?)\beyJ[\w-]+\.[\w-]+\.[\w-]+"),
    (r"<TOKEN>", r"(?i)\b(?:set-)?cookie\s*:\s*\S+"),
    (r"\1<TOKEN>", r"(?i)(?<![\w-])(-*)\b(?!(?:max_tokens|tokens)\s*[:=]\s*[0-9]+(?=\s|$))(?=[\w-]*(?:api[_-]?key|access[_-]?key|token|secret|password|passwd))[\w-]+\s*[:=]\s*\S+"),
    (r"<TOKEN>", r"(?i)\b(?:api[_-]?key|access[_-]?key|token|secret|password|passwd|pwd|senha|chave)\s*(?:[:=]|\bis\b|\bé\b|\bwas\b|\bera\b)\s*\S+"),
    (r"<TOKEN>", r"(?i)\b(?:api[_-]?key|access[_-]?key|token|secret|password|passwd|pwd|senha|chave)\s+(?=\S*\d)\S+"),
    (r"<TOKEN>", r"\b(?:sk|pk|rk|ghp|gho|ghs|ghu|github_pat|glpat|xox[abprs]|hf|AKIA)[-_][\w-]{8,}"),
    (r"<TOKEN>", r"\bAKIA[0-9A-Z]{12,}\b"),
    (r"<TOKEN>", r"\b[\w-]{32,}\b"),
    (r"<TOKEN>", r"\b(?=\w{20,}\b)\w*?(?=[A-Za-z0-9]*[a-z])(?=[A-Za-z0-9]*[A-Z])(?=[A-Za-z0-9]*\d)[A-Za-z0-9]{12,}\w*\b"),
    (r"<HOST>", r"(?i)(?<![\w:])(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:)*[0-9a-f]{0,4}::(?:[0-9a-f]{1,4}:)*[0-9a-f]{0,4})(?![\w:])"),
    (r"<PATH>", r"\\\\[\w.$-]+\\\S*"),
    (r"<PATH>", r"\b[A-Za-z]:[\\/]\S+"),
    (r"<PATH>", r"(?<![\w])(?:~|\.{1,2})?/[\w.~-]+(?:/[\w.~-]*)*"),
    (r"\1<PATH>", r"(?<![\w.-])(?<![\w.-]/)([.-]*+(?:/[.-]*+)*+)\w[\w.-]*(?:/[\w.-]+)+\.\w{1,6}\b"),
    (r"<HOST>", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    (r"<HOST>", r"(?<![A-Za-z0-9.-])(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b"),
    (r"<HOST>", r"\b[A-Za-z][\w-]*:\d{2,5}\b|\blocalhost\b"),
    (r"<VALUE>", r"\"[^\"]*\"|`[^`]*`|“[^”]*”|‘[^’]*’|(?<!\w)'[^'\n]+'(?!\w)"),
    (r"<NUMBER>", r"\b\d[\d.,/:-]{3,}\d\b"),
    (r"<NUMBER>", r"(?<!\d)\d{9,}(?!\d)"),
)
_READY = [(mark, re.compile(p)) for mark, p in RULES]
# a text that is handed on keeps long names: a long word is a secret only with a digit in it
_SECRETS = [(mark, re.compile(r"\b(?=[\w-]*\d)[\w-]{32,}\b") if p.pattern == r"\b[\w-]{32,}\b" else p) for mark, p in _READY if mark.endswith("<TOKEN>")]


def _apply(rules: list, text: str | None) -> str | None:
    if text is None:
        return None
    for mark, p in rules:
        text = p.sub(mark, text)
    return text


@F.pandas_udf(T.StringType())
def redact(s: pd.Series) -> pd.Series:
    """Every rule."""
    return pd.Series([_apply(_READY, t) for t in s], dtype=object)


@F.pandas_udf(T.StringType())
def mask_secrets(s: pd.Series) -> pd.Series:
    """Keys, tokens, passwords and the like only, for texts that are handed on."""
    return pd.Series([_apply(_SECRETS, t) for t in s], dtype=object)


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the text masked and, in ``marks``, how often each kind of mark was set, as a map."""
    kinds = ("URL", "EMAIL", "TOKEN", "HOST", "PATH", "VALUE", "NUMBER")
    out = df.withColumn("was", F.col(text)).withColumn(text, redact(text))
    n = lambda c, k: F.regexp_count(c, F.lit(f"<{k}>"))
    marks = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*[n(F.col(text), k) - n(F.col("was"), k) for k in kinds])), lambda _, v: v > 0)
    return out.withColumn("marks", marks).drop("was")
