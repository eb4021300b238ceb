"""Column expressions: dates, kinds, names, paths, geometry and vectors.  No UDFs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of media by MIME type and extension, and the type that means "unknown".
PHOTO_MIMES = ["image/jpeg", "image/png", "image/gif", "image/webp", "image/bmp", "image/tiff", "image/heic"]
VIDEO_MIMES = ["video/quicktime", "video/mp4"]
UNKNOWN_MIME = "application/octet-stream"
EXT_MIME = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp",
    "tiff": "image/tiff", "tif": "image/tiff", "dng": "image/tiff", "heic": "image/heic", "mov": "video/quicktime", "mp4": "video/mp4", "m4v": "video/mp4",
}
#: Extensions of the statistics' fallback: they lack tif and m4v, unlike the map above.
STATS_PHOTO_EXTS = ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tiff", "heic", "dng"]
STATS_VIDEO_EXTS = ["mov", "mp4"]
EARTH_KM = 6371.0


def is_real_date(text: Column) -> Column:
    """A capture date that was written, not a camera's row of zeros."""
    return text.isNotNull() & ~text.startswith("0000")


def effective_date(exif: Column, modified: Column) -> Column:
    """Search's date: the capture date, else the modification date; text, never parsed."""
    return F.when(is_real_date(exif), exif).otherwise(modified)


def best_date(exif: Column, created: Column, modified: Column) -> Column:
    """Deduplication's date: the capture date, else the earlier of the two file dates, else ''."""
    return F.coalesce(F.when(is_real_date(exif), exif), F.least(created, modified), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ext_mime(ext: Column) -> Column:
    """MIME type by extension, or null."""
    low = F.lower(ext)
    return reduce(lambda c, kv: c.when(low == kv[0], kv[1]), list(EXT_MIME.items())[1:], F.when(low == "jpg", EXT_MIME["jpg"]))


def effective_mime(mime: Column, ext: Column) -> Column:
    """The stored type if it is a known one, else the extension's."""
    return F.coalesce(F.when(mime.isin(PHOTO_MIMES + VIDEO_MIMES), mime), ext_mime(ext))


def is_kind(kind: str, mime: Column, ext: Column) -> Column:
    known = effective_mime(mime, ext)
    return F.coalesce(known.isin(kind_mimes(kind)), F.lit(False))


def kind_mimes(kind: str) -> list[str]:
    if kind not in ("image", "video"):
        raise ValueError(f"unknown kind {kind!r}; valid kinds: image, video")
    return PHOTO_MIMES if kind == "image" else VIDEO_MIMES


def is_embeddable(mime: Column, ext: Column) -> Column:
    return (F.lower(F.coalesce(ext, F.lit(""))) != "dng") & effective_mime(mime, ext).isNotNull()


def stats_is_photo(mime: Column, ext: Column) -> Column:
    """By stored type, by extension only where no type is stored; the unknown type is a stored one."""
    return F.coalesce(mime.isin(PHOTO_MIMES) | (mime.isNull() & ascii_lower(ext).isin(STATS_PHOTO_EXTS)), F.lit(False))


def stats_is_video(mime: Column, ext: Column) -> Column:
    return F.coalesce(mime.isin(VIDEO_MIMES) | (mime.isNull() & ascii_lower(ext).isin(STATS_VIDEO_EXTS)), F.lit(False))


def normalise_ext(ext: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(ext), r"^\.+", ""))


def path_ext(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def path_is_kind(kind: str, path: Column) -> Column:
    exts = [e for e, m in EXT_MIME.items() if m in kind_mimes(kind)]
    return path_ext(path).isin(exts)


def under(path: Column, roots: list[str]) -> Column:
    """Whether a path is a root or lies below one, by whole components."""

    def below(root: str) -> Column:
        root = root.rstrip("/")
        return (path == (root or "/")) | path.startswith(root + "/")

    return reduce(lambda a, b: a | b, map(below, roots), F.lit(False))


def parent_folder(path: str) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def sniff(content: Column) -> Column:
    """MIME type from the first twelve bytes, or null; shorter contents are unknown."""
    head = F.hex(F.substring(content, 1, 12))
    at = lambda s, n: F.substring(head, 2 * s + 1, 2 * n)
    tag = lambda *names: [n.encode().hex().upper() for n in names]
    brand = at(8, 4)
    # Magic numbers and box names of the formats.
    return (
        F.when(F.length(head) < 24, None)
        .when(at(0, 3) == "FFD8FF", "image/jpeg")
        .when(at(0, 8) == "89504E470D0A1A0A", "image/png")
        .when(at(0, 6).isin(tag("GIF87a", "GIF89a")), "image/gif")
        .when(at(0, 2).isin(tag("BM")), "image/bmp")
        .when(at(0, 4).isin("49492A00", "4D4D002A"), "image/tiff")
        .when(at(0, 4).isin(tag("RIFF")) & brand.isin(tag("WEBP")), "image/webp")
        .when(at(4, 4).isin(tag("ftyp")) & brand.isin(tag("heic", "heix", "hevc", "hevx", "mif1", "msf1")), "image/heic")
        .when(at(4, 4).isin(tag("ftyp")) & at(8, 2).isin(tag("qt")), "video/quicktime")
        .when(at(4, 4).isin(tag("ftyp")), "video/mp4")
        .when(at(4, 4).isin(tag("wide", "mdat", "moov", "free", "skip", "pnot")), "video/quicktime")
    )


# --- names ----------------------------------------------------------------

# Letters that fold to a plain one, by that letter.
FOLDS = {
    "a": "áàâäãåāăąÁÀÂÄÃÅĀĂĄ", "e": "éèêëēėęěÉÈÊËĒĖĘĚ", "i": "ıİíìîïīįÍÌÎÏĪĮ", "o": "öÖóòôõøōÓÒÔÕØŌ", "u": "üÜúùûūůÚÙÛŪŮ", "n": "ñńňÑŃŇ", "y": "ýÿÝŸ",
    "c": "çÇćčĆČ", "s": "şŞśšŚŠß", "z": "źżžŹŻŽ", "l": "łŁ", "d": "đðĐ", "g": "ğĞ",
}


def fold(text: Column) -> Column:
    letters = "".join(FOLDS.values())
    return F.translate(text, letters, "".join(k * len(v) for k, v in FOLDS.items()))


def normalize_name(raw: Column) -> Column:
    """The identity form of a name: folded, lower case, separators to one underscore; null if nothing is left."""
    s = F.lower(fold(raw))
    s = F.regexp_replace(s, r"(?U)[\s_]+", "_")
    s = F.regexp_replace(s, r"[^a-z0-9_]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"_+", "_"), r"^_+|_+$", "")
    return F.nullif(s, F.lit(""))


def display_name(raw: Column) -> Column:
    """What was typed, without control and format characters, white space joined, at most 60 characters."""
    s = F.regexp_replace(raw, r"[\p{Cc}\p{Cf}]", "")
    s = F.trim(F.regexp_replace(s, r"(?U)\s+", " "))
    return F.nullif(F.substring(s, 1, 60), F.lit(""))


def geocode_key(text: Column) -> Column:
    return F.lower(F.trim(text))


# --- numbers and text -----------------------------------------------------


def human_bytes(n: Column) -> Column:
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, unit in enumerate(units[1:], 1):
        text = F.concat(F.format_string("%.1f", n / float(1024**i)), F.lit(f" {unit}"))
        out = out.otherwise(text) if unit == "TB" else out.when(n < float(1024 ** (i + 1)), text)
    return out


def human_duration(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    pair = lambda a, ua, b, ub: F.when(b == 0, F.concat(a, F.lit(ua))).otherwise(F.concat(a, F.lit(ua + " "), b, F.lit(ub)))
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(s < 10, F.concat(F.format_string("%.1f", ms / 1000.0), F.lit("s")))
        .when(s < 60, F.concat(s, F.lit("s")))
        .when(s < 3600, pair(F.floor(s / 60), "m", F.pmod(s, F.lit(60)), "s"))
        .otherwise(pair(F.floor(s / 3600), "h", F.floor(F.pmod(s, F.lit(3600)) / 60), "m"))
    )


def rational(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def dms_to_decimal(d: Column, m: Column, s: Column, ref: Column) -> Column:
    value = d + m / 60 + s / 3600
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def iso6709(text: Column) -> tuple[Column, Column]:
    """(lat, lon) of ``+lat+lon[+alt]/``; both null if any character or range is off."""
    s = F.regexp_replace(F.trim(text), r"/+$", "")
    ok = s.rlike(r"^[+\-0-9.]+$")
    parts = F.regexp_extract_all(s, F.lit(r"([+\-]?[^+\-]*)"), F.lit(1))
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    lat, lon = number(0), number(1)
    valid = ok & lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(valid, lat), F.when(valid, lon)


def apple_date(text: Column) -> Column:
    """The first 19 characters of a trimmed date whose separators line up; the offset is dropped."""
    s = F.trim(text)
    return F.when(s.rlike(r"^.{4}-.{2}-.{2}T.{2}:.{2}:.{2}"), F.substring(s, 1, 19))


#: Seconds from 1904-01-01 to 1970-01-01, the two epochs of movie headers and of Unix.
MOVIE_EPOCH = 2_082_844_800


def mvhd_date(seconds: Column) -> Column:
    """UTC text of seconds since 1904; null up to the Unix epoch."""
    unix = seconds - F.lit(MOVIE_EPOCH)
    days, rest = F.floor(unix / 86400), F.pmod(unix, F.lit(86400))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")).cast("string")
    clock = F.concat_ws(":", two(F.floor(rest / 3600)), two(F.floor(F.pmod(rest, F.lit(3600)) / 60)), two(F.pmod(rest, F.lit(60))))
    return F.when(unix > 0, F.concat(day, F.lit("T"), clock))


def rfc3339(ts: Column) -> Column:
    """UTC text with offset, of a timestamp without zone."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def bbox_parts(bbox: Column) -> list[Column]:
    parts = F.split(bbox, ",")
    return [F.get(parts, F.lit(i)).try_cast("double") for i in range(4)]


def bbox_min_side(bbox: Column) -> Column:
    """The shorter side of an ``x,y,w,h`` box; 0 if it is malformed."""
    parts = bbox_parts(bbox)
    ok = F.size(F.split(bbox, ",")) == 4
    for p in parts:
        ok = ok & p.isNotNull()
    return F.when(ok, F.least(parts[2], parts[3])).otherwise(F.lit(0.0))


def bbox_corners(bbox: Column) -> Column:
    x, y, w, h = bbox_parts(bbox)
    return F.array(x, y, x + w, y + h)


def model_slug(model_id: Column) -> Column:
    return F.replace(model_id, F.lit("/"), F.lit("--"))


def model_from_slug(slug: Column) -> Column:
    return F.regexp_replace(slug, r"^(.*?)--", "$1/")


def hash_from_cache_name(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"^([0-9a-f]{64})_", 1), F.lit(""))


def split_counter(name: Column) -> tuple[Column, Column]:
    """``a(1).jpg`` as (``a.jpg``, ``1``); nulls without a numeric counter."""
    pattern = r"^(.*?)\s*\(([0-9]+)\)(\.[^.]*)?$"
    hit = name.rlike(pattern)
    return F.when(hit, F.concat(F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 3))), F.when(hit, F.regexp_extract(name, pattern, 2))


def strip_edited(name: Column) -> Column:
    pattern = r"^(.*)-edited(\.[^.]*)?$"
    return F.when(name.rlike(pattern), F.concat(F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)))


# --- geometry -------------------------------------------------------------


def _half_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    return F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2.0))


def haversine_asin(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres, the search's form."""
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(_half_chord(lat1, lon1, lat2, lon2), F.lit(1.0))))


def haversine_atan2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres, the place clustering's form."""
    a = F.least(_half_chord(lat1, lon1, lat2, lon2), F.lit(1.0))
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def box_around(lat: float, lon: float, km: float, lat_col: Column, lon_col: Column) -> Column:
    """A rectangle that holds the circle: plain comparisons that reach the Parquet reader."""
    import math

    dlat = math.degrees(km / EARTH_KM) + 1e-9
    out = lat_col.between(lat - dlat, lat + dlat)
    if abs(lat) + dlat < 89:
        dlon = math.degrees(math.asin(min(1.0, math.sin(min(math.pi / 2, km / EARTH_KM)) / math.cos(math.radians(lat))))) + 1e-9
        if lon - dlon >= -180 and lon + dlon <= 180 and km < EARTH_KM:
            out = out & lon_col.between(lon - dlon, lon + dlon)
    return out


# --- vectors --------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths or a zero vector."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
