"""The filter algebra: predicates that resolve to sets of content hashes and combine with AND.

A predicate is a one-column DataFrame of hashes.  A path is in a result if any
copy of its content passed, so filters are semi-joins on the hash and never row
filters.  No filter at all (None) means everything; an empty set means nothing.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.functions import columns as C

DATE_FORMS = "expected YYYY, YYYY-MM, YYYY-MM-DD, or YYYY-MM-DDTHH:MM:SS"


def expand_date(spec: str) -> tuple[str, str]:
    """A year, month or day as a half-open range of ISO texts."""
    parts = spec.split("-")
    try:
        y, *rest = map(int, parts)
        if not rest:
            start, end = date(y, 1, 1), date(y + 1, 1, 1)
        elif len(rest) == 1:
            start = date(y, rest[0], 1)
            end = date(y + rest[0] // 12, rest[0] % 12 + 1, 1)
        elif len(rest) == 2:
            start = date(y, *rest)
            end = start + timedelta(days=1)
        else:
            raise ValueError
    except (ValueError, OverflowError):
        raise ValueError(f"cannot parse date {spec!r}; {DATE_FORMS}") from None
    return f"{start}T00:00:00", f"{end}T00:00:00"


def normalise_bound(spec: str) -> str:
    """A bound with a time stays as it is; a shorthand becomes its start."""
    return spec if "T" in spec else expand_date(spec)[0]


def by_date(files: DataFrame, after: str | None, before: str | None) -> DataFrame:
    when = C.effective_date(F.col("exif_date"), F.col("modified_at"))
    rows = files.where(when.isNotNull())
    if after is not None:
        rows = rows.where(when >= after)
    if before is not None:
        rows = rows.where(when < before)
    return rows.select("hash").distinct()


def resolve_identities(people: DataFrame, typed: str) -> DataFrame:
    """Identities a typed name may mean: its normalised form, and people so called."""
    spark = people.sparkSession
    given = spark.createDataFrame([(typed,)], "typed string").select("typed", C.normalize_name(F.col("typed")).alias("norm"))
    own = given.where("norm IS NOT NULL").select(F.col("norm").alias("name"))
    low = F.lower(F.trim(F.lit(typed)))
    norm = C.normalize_name(F.lit(typed))
    same = (F.lower(F.trim("full_name")) == low) | F.coalesce(C.normalize_name(F.col("full_name")) == norm, F.lit(False))
    return own.union(people.where(same).select("name")).distinct()


def by_person(faces: DataFrame, people: DataFrame, typed: str) -> DataFrame:
    ids = resolve_identities(people, typed).withColumnRenamed("name", "person_label")
    return faces.where("confirmed = 1").join(ids, "person_label", "left_semi").select("hash").distinct()


def by_category(classifications: DataFrame, model: str, category: str) -> DataFrame:
    return classifications.where((F.col("model_id") == model) & (F.col("category") == category)).select("hash").distinct()


def by_location(files: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """(hash, distance_km): nearest copy's distance, for hashes within the radius, its edge included."""
    near = files.where(F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull() & C.box_around(lat, lon, km, F.col("gps_lat"), F.col("gps_lon")))
    away = near.select("hash", C.haversine_asin(F.lit(lat), F.lit(lon), F.col("gps_lat"), F.col("gps_lon")).alias("distance_km"))
    return away.where(F.col("distance_km") <= km).groupBy("hash").agg(F.min("distance_km").alias("distance_km"))


def by_kinds(files: DataFrame, kinds: list[str]) -> DataFrame:
    ok = reduce(lambda a, b: a | b, [C.is_kind(k, F.col("mime"), F.col("ext")) for k in kinds])
    return files.where(ok).select("hash").distinct()


def by_exts(files: DataFrame, exts: list[str]) -> DataFrame:
    wanted = [re.sub(r"^\.+", "", e.strip()).lower() for e in exts]
    return files.where(C.normalise_ext(F.col("ext")).isin(wanted)).select("hash").distinct()


def by_mimes(files: DataFrame, mimes: list[str]) -> DataFrame:
    return files.where(F.lower("mime").isin([m.strip().lower() for m in mimes])).select("hash").distinct()


def roots_in_both_forms(roots: list[str]) -> list[str]:
    """Each root, and its canonical form if that differs."""
    out = []
    for r in roots:
        for form in (r, os.path.realpath(r) if os.path.exists(r) else r):
            if form not in out:
                out.append(form)
    return out


def by_paths(files: DataFrame, roots: list[str]) -> DataFrame:
    return files.where(C.under(F.col("path"), roots_in_both_forms(roots))).select("hash").distinct()


@dataclass(frozen=True)
class Selection:
    """Filters that all must hold; an axis left empty doesn't filter."""

    person: str | None = None
    category: tuple[str, str] | None = None  # (model, category)
    after: str | None = None
    before: str | None = None
    kinds: list[str] = field(default_factory=list)
    exts: list[str] = field(default_factory=list)
    mimes: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    place: tuple[float, float, float] | None = None  # (lat, lon, km)

    def is_empty(self) -> bool:
        return self == Selection()

    def parts(self, lib) -> list[DataFrame]:
        """The sets of the active axes, in a fixed order."""
        out = []
        if self.person is not None:
            out.append(by_person(lib.faces, lib.people, self.person))
        if self.category is not None:
            out.append(by_category(lib.classifications, *self.category))
        if self.after is not None or self.before is not None:
            out.append(by_date(lib.file_hashes, self.after, self.before))
        if self.kinds:
            out.append(by_kinds(lib.file_hashes, self.kinds))
        if self.exts:
            out.append(by_exts(lib.file_hashes, self.exts))
        if self.mimes:
            out.append(by_mimes(lib.file_hashes, self.mimes))
        if self.paths:
            out.append(by_paths(lib.file_hashes, self.paths))
        return out

    def resolve(self, lib) -> tuple[DataFrame | None, DataFrame | None]:
        """(hashes or None for everything, distances or None without a place)."""
        near = by_location(lib.file_hashes, *self.place) if self.place else None
        sets = self.parts(lib) + ([near.select("hash")] if near is not None else [])
        if not sets:
            return None, None
        return reduce(lambda a, b: a.join(b, "hash", "left_semi"), sets), near

    def describe(self) -> str:
        """The active axes as text."""
        said = [f"person={self.person}" if self.person else "", f"category={self.category[1]}" if self.category else "", f"after={self.after}" if self.after else "", f"before={self.before}" if self.before else ""]
        said += [f"{n}={','.join(v)}" for n, v in (("type", self.kinds), ("ext", self.exts), ("mime", self.mimes), ("path", self.paths)) if v]
        said += [f"place={self.place[0]},{self.place[1]} within {self.place[2]}km"] if self.place else []
        return " ".join(x for x in said if x) or "everything"


@dataclass(frozen=True)
class PathSelection:
    """Filters that a path alone decides, before any content is read."""

    kinds: list[str] = field(default_factory=list)
    exts: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)

    def apply(self, rows: DataFrame, path: str = "path") -> DataFrame:
        p = F.col(path)
        if self.kinds:
            rows = rows.where(reduce(lambda a, b: a | b, [C.path_is_kind(k, p) for k in self.kinds]))
        if self.exts:
            rows = rows.where(C.path_ext(p).isin([re.sub(r"^\.+", "", e.strip()).lower() for e in self.exts]))
        if self.paths:
            rows = rows.where(C.under(p, roots_in_both_forms(self.paths)))
        return rows


def narrow(pending: DataFrame, selected: DataFrame | None) -> DataFrame:
    """Pending hashes that are also selected."""
    return pending if selected is None else pending.join(selected, "hash", "left_semi")


def narrow_report(pending: DataFrame, selected: DataFrame | None) -> DataFrame:
    """One row: how many of the eligible are to do, and why none is."""
    eligible = pending.agg(F.count("*").alias("eligible"))
    chosen = narrow(pending, selected).agg(F.count("*").alias("chosen"))
    state = F.when(F.col("eligible") == 0, "all done").when(F.col("chosen") == 0, "selection matched nothing").otherwise("work")
    return eligible.join(chosen).select("eligible", "chosen", state.alias("state"))
