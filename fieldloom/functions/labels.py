"""Names, labels, codes and numbers: scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_name(x: Column) -> Column:
    """Letters, digits and - _ . stay, all else becomes _; a blank name is unnamed."""
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(x.cast("string")), r"[^\p{L}\p{N}\-_.]", "_"), F.lit("")), F.lit("unnamed"))


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the zone: the Australian grid in its box, else the northern or southern UTM zone."""
    zone = F.floor((lon + 180) / 6).cast("int") + 1
    home = (lon >= 112) & (lon <= 154) & (lat >= -44) & (lat <= -9)
    return F.when(home, 7800 + zone).when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


def epsg_of(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(?i)EPSG:*(\d+)", 1), F.lit("")).cast("int")


def compress_key(label: Column) -> Column:
    low = F.lower(label)
    return F.when(low.startswith("none") | low.startswith("unc"), "none").when(low.startswith("lzw"), "lzw").otherwise("deflate")


def bits_key(label: Column) -> Column:
    x = F.trim(label.cast("string"))
    return F.when(x.isin("8", "16"), x).otherwise("same")


def format_ext(label: Column) -> Column:
    up = F.upper(label)
    return F.when(up.startswith("GEO") | up.startswith("TIF"), ".tif").when(up.startswith("PNG"), ".png").otherwise(".jpg")


def to_8_bit(v: Column) -> Column:
    return F.floor((v + 128) / 257).cast("int")


def to_16_bit(v: Column) -> Column:
    return v * 257


def row_spec(spec: Column) -> Column:
    """Struct mode, n, rows of a choice of rows: "all" ("", "all", "*"), "middle" with n ("middle 3"), or "list" with its numbers in order, each once ("1,2,5-7").

    Numbers count from 1.  A range that runs down ("7-5") has no numbers.  A
    list without numbers or with smaller ones, a part that is neither a number
    nor a range ("1-2-3"), and "middle" without a number raise an error.
    """
    low = F.lower(F.trim(F.coalesce(spec, F.lit(""))))
    every, middle = low.isin("", "all", "*"), low.startswith("middle")
    parts = F.filter(F.transform(F.split(F.replace(low, F.lit(";"), F.lit(",")), ","), lambda x: F.trim(x)), lambda x: x != "")
    end = lambda x, i: F.regexp_extract(x, r"^(\d+)\s*-?\s*(\d*)$", i).try_cast("int")
    last = lambda x: F.when(x.contains("-"), end(x, 2)).otherwise(end(x, 1))
    one = lambda x: F.when(last(x) >= end(x, 1), F.sequence(end(x, 1), last(x))).otherwise(F.array().cast("array<int>"))
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, one))))
    odd = F.exists(parts, lambda x: ~F.regexp_like(x, F.lit(r"^\d+(\s*-\s*\d+)?$")))
    n = F.regexp_extract(low, r"(\S+)$", 1).try_cast("int")
    wrong = F.when(middle, n.isNull()).otherwise(~every & (odd | F.coalesce(F.array_min(numbers) < 1, F.lit(True))))
    mode = F.when(wrong, F.raise_error(F.concat(F.lit("rows '"), spec, F.lit("': use all, middle N or numbers from 1 on")))).when(every, "all").when(middle, "middle").otherwise("list")
    return F.struct(mode.alias("mode"), F.when(middle, F.greatest(F.lit(1), n)).alias("n"), F.when(~every & ~middle, numbers).alias("rows"))


def plot_label(bank: Column, place: Column) -> Column:
    """Label of a plot, from its bank and range, counted from 0."""
    return F.format_string("Rg%dRw%d", bank + 1, place + 1)


def plot_number(bank: Column, place: Column) -> Column:
    return (bank + 1) * 1000 + place + 1


def tile_name(stem: Column, col: Column, row: Column) -> Column:
    return F.concat(stem.cast("string"), F.lit("_tile_c"), col.cast("string"), F.lit("_r"), row.cast("string"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")
