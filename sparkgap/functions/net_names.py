"""Net names: their normal form, tokens and the voltage written in them."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The marks that separate the words of a net name.
SEPARATORS = "-+. /"


def _folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.upper(text), SEPARATORS, "_" * len(SEPARATORS)), "_+", "_"), F.lit("_"))


@F.pandas_udf(StringType())
def _compatible(names: pd.Series) -> pd.Series:
    """NFKC, without control and format characters."""
    seen: dict = {}

    def of(name):
        if name is None:
            return None
        if name not in seen:
            seen[name] = "".join(c for c in unicodedata.normalize("NFKC", name) if unicodedata.category(c) not in ("Cc", "Cf"))
        return seen[name]

    return names.map(of)


@F.pandas_udf(StringType())
def _nfkc(names: pd.Series) -> pd.Series:
    """NFKC alone."""
    return names.map(lambda name: None if name is None else unicodedata.normalize("NFKC", name))


def has_plain_ascii(name: Column) -> Column:
    return name.rlike(r"^[\x20-\x7E]*$")


def normal_name_ascii(name: Column) -> Column:
    """The normal form of a name of printable ASCII characters; stays in the JVM."""
    return _folded(name)


def compatible_text(text: Column) -> Column:
    """Unicode compatibility form without control and format characters; null stays null."""
    return F.when(has_plain_ascii(text), text).otherwise(_compatible(text))


def normal_name(name: Column, *, any_script: bool = True) -> Column:
    """The normal form under which two spellings are the same net; null stays null.

    Compatibility form, without control and format characters, upper case, runs
    of separators as one `_`, none at the ends. Names of printable ASCII need no
    Python; the others go through an Arrow UDF once per distinct name of a batch.
    """
    if not any_script:
        return _folded(F.regexp_replace(name, r"[\p{Cc}\p{Cf}]", ""))
    return _folded(compatible_text(name))


def rejected_name(name: Column) -> Column:
    """Whether a name holds control or format characters, which no rule may match."""
    return name.rlike(r"[\p{Cc}\p{Cf}]")


def name_tokens(normal: Column) -> Column:
    """The words of a normal name."""
    return F.filter(F.split(normal, "_"), lambda t: t != "")


# A voltage token such as 3V3, 12V, -15V, M12V; else HV and two to four digits.
VOLTAGE_TOKEN = r"(?<![A-Z0-9])([+\-PMN]?)(\d+)V(\d*)(?![A-Z0-9])"
HV_TOKEN = r"(?<![A-Z0-9])HV(\d{2,4})(?![A-Z0-9])"


def name_voltage(name: Column) -> Column:
    """The voltage in volts that a net name states, else null. `-`, `M` and `N` make it negative.

    Full-width and other compatible spellings count as what they stand for;
    control and format characters stay and so part a token.
    """
    plain = has_plain_ascii(name)
    text = F.translate(F.upper(F.when(plain, name).otherwise(_nfkc(F.when(~plain, name)))), ". /", "___")
    sign, whole, rest = (F.regexp_extract(text, VOLTAGE_TOKEN, k) for k in (1, 2, 3))
    volts = F.concat(whole, F.lit("."), F.when(rest == "", "0").otherwise(rest)).try_cast("double")
    high = F.regexp_extract(text, HV_TOKEN, 1)
    return F.when(whole != "", F.when(sign.isin("-", "M", "N"), -volts).otherwise(volts)).when(high != "", high.try_cast("double"))
