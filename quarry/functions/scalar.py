"""Scalar functions of the catalogue, as Column expressions: they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of the categories.
CATEGORY_EXTENSIONS = {
    "image": "jpg jpeg png gif bmp tiff tif webp svg ico raw cr2 cr3 nef arw dng orf rw2 raf pef psd heic heif avif",
    "document": "pdf doc docx xls xlsx ppt pptx txt rtf odt ods odp csv md html htm xml json epub eml msg",
    "video": "mp4 avi mkv mov wmv flv webm m4v mpg mpeg 3gp 3g2 ts vob",
    "audio": "mp3 wav flac aac ogg wma m4a m4b opus aiff ape mid midi",
    "archive": "zip rar 7z tar gz bz2 xz iso dmg cab zst",
    "database": "db sqlite sqlite3 mdb accdb sql dbf",
}
CATEGORY_LABELS = {"all": "All files", "image": "Images", "document": "Documents", "video": "Video", "audio": "Audio", "archive": "Archives", "database": "Databases", "other": "Other"}
SIZE_UNITS = ("KB", "MB", "GB", "TB", "PB")
EPOCH_GAP = 116_444_736_000_000_000  # 100 ns steps from 1601 to 1970


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cases(pairs, otherwise: object = None) -> Column:
    """Ordered CASE: the first condition that holds decides."""
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def format_size(size: Column | str, units: tuple[str, ...] = SIZE_UNITS) -> Column:
    """Bytes as text with two decimals of a 1024-based unit, rounded half up from integers; negative: unknown. The last of the
    units serves all larger sizes."""
    n = c(size).cast("long")
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))
    tiers = []
    for i in range(len(units), 0, -1):
        unit = 1024**i
        # the rest is multiplied, not the size, which could leave the type
        hundredths = div(n, unit) * 100 + div(n % unit * 200 + unit, 2 * unit)
        text = F.concat(div(hundredths, 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit(f" {units[i - 1]}"))
        tiers.append((n >= unit, text))
    return cases([(n < 0, F.lit("unknown")), *tiers], F.concat(n.cast("string"), F.lit(" B")))


def format_duration(seconds: Column | str) -> Column:
    """Under a minute tenths of seconds, under an hour minutes and seconds, else hours and minutes."""
    s = c(seconds).cast("double")
    tenths, whole = F.round(s * 10).cast("long"), F.floor(s).cast("long")
    part = lambda x: F.floor(x).cast("long").cast("string")
    return cases(
        [
            (s < 60, F.concat(part(tenths / 10), F.lit("."), (tenths % 10).cast("string"), F.lit(" s"))),
            (s < 3600, F.concat(part(whole / 60), F.lit(" min "), (whole % 60).cast("string"), F.lit(" s"))),
        ],
        F.concat(part(whole / 3600), F.lit(" h "), part((whole % 3600) / 60), F.lit(" min")),
    )


def category_of(extension: Column | str) -> Column:
    """Category of a lower-case extension; other if unknown or null."""
    e = c(extension)
    return cases([(e.isin(*names.split()), F.lit(kind)) for kind, names in CATEGORY_EXTENSIONS.items()], F.lit("other"))


def category_label(category: Column | str) -> Column:
    k = c(category)
    return cases([(k == key, F.lit(label)) for key, label in CATEGORY_LABELS.items()], F.lit(CATEGORY_LABELS["other"]))


def confidence_tier(confidence: Column | str, is_valid: Column | str) -> Column:
    """invalid: low; from .85 high, from .6 medium, from .3 partial, else low. Validity has three states."""
    x = F.coalesce(c(confidence), F.lit(0.0))
    return cases([(c(is_valid).eqNullSafe(False), F.lit("low")), (x >= 0.85, F.lit("high")), (x >= 0.6, F.lit("medium")), (x >= 0.3, F.lit("partial"))], F.lit("low"))


def recovery_score(confidence: Column | str, is_valid: Column | str) -> Column:
    """Confidence in percent, clamped and rounded half up; where that is 0: 72 if valid, 30 if not, 45 if unknown."""
    percent = F.floor(F.least(F.greatest(F.coalesce(c(confidence), F.lit(0.0)) * 100, F.lit(0.0)), F.lit(100.0)) + 0.5).cast("int")
    v = c(is_valid)
    return cases([(percent > 0, percent), (v.eqNullSafe(True), F.lit(72)), (v.eqNullSafe(False), F.lit(30))], F.lit(45))


def recoverability(has_runs: Column, size: Column, resident: Column, name: Column) -> Column:
    """0.4 for runs, 0.2 for a size, 0.3 for resident data, 0.1 for a name; at most 1."""
    part = lambda cond, w: F.when(cond, F.lit(w)).otherwise(0.0)
    return F.least(F.round(part(has_runs, 0.4) + part(size > 0, 0.2) + part(resident, 0.3) + part(F.coalesce(name, F.lit("")) != "", 0.1), 6), F.lit(1.0))


def filetime(ticks: Column | str) -> Column:
    """100 ns steps since 1601 as a timestamp without zone; null where not positive."""
    t = c(ticks)
    micros = F.expr("0") + F.floor((t - F.lit(EPOCH_GAP)) / 10).cast("long")
    return F.when(t > 0, F.timestamp_micros(micros).cast("timestamp_ntz"))


def dos_datetime(date: Column | str, time: Column | str) -> Column:
    """Packed DOS date and time as a timestamp; null for a date of 0 or one that doesn't exist."""
    d, t = c(date).cast("int"), c(time).cast("int")
    parts = [F.shiftright(d, 9) + 1980, F.shiftright(d, 5).bitwiseAND(15), d.bitwiseAND(31), F.shiftright(t, 11), F.shiftright(t, 5).bitwiseAND(63), t.bitwiseAND(31) * 2]
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", *parts)
    return F.when(d > 0, F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def exif_time(text: Column | str) -> Column:
    return F.try_to_timestamp(c(text), F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")


def archive_dir(ts: Column | str) -> Column:
    """yyyy/MM, or Unknown_Date without a time."""
    return F.coalesce(F.date_format(c(ts), "yyyy/MM"), F.lit("Unknown_Date"))


def guid_text(b: Column | str) -> Column:
    """Mixed-endian GUID of 16 bytes: the first three parts are little endian."""
    x = c(b)
    byte = lambda i: F.hex(F.substring(x, i, 1))
    dash = F.lit("-")
    groups = [(4, 3, 2, 1), (6, 5), (8, 7), (9, 10), (11, 12, 13, 14, 15, 16)]
    out = []
    for g in groups:
        out += [*([dash] if out else []), *(byte(i) for i in g)]
    return F.when(F.length(x) == 16, F.concat(*out))


def utf16le(b: Column | str) -> Column:
    """UTF-16LE bytes as text, up to the first zero."""
    return F.split(F.decode(c(b), "UTF-16LE"), "\u0000", 2)[0]


def ntfs_file_id(partition_offset: Column | str, entry: Column | str) -> Column:
    return F.concat(F.lit("ntfs_"), F.hex(c(partition_offset).cast("long")), F.lit("_"), c(entry).cast("string"))


def carve_file_id(number: Column | str) -> Column:
    return F.concat(F.lit("carve_"), c(number).cast("string"))


def semver(version: Column | str) -> Column:
    """(major, minor, patch) of v1.2.3, with or without v and a suffix; null if it has no such parts."""
    parts = [F.regexp_extract(c(version), r"^v?(\d+)\.(\d+)(?:\.(\d+))?", i) for i in (1, 2, 3)]
    number = lambda p: F.when(p == "", F.lit(0)).otherwise(p.cast("int"))
    return F.when(parts[0] != "", F.struct(*[number(p).alias(k) for p, k in zip(parts, ("major", "minor", "patch"))]))


def is_newer(local: Column | str, remote: Column | str) -> Column:
    return F.coalesce(semver(remote) > semver(local), F.lit(False))


def sufficiency(needed: Column, available: Column) -> Column:
    """unknown, short, tight or ample: ample leaves a margin of 30 % and of 1 GiB at least."""
    margin = F.greatest(needed * 0.3, F.lit(float(1 << 30)))
    bad = needed.isNull() | (needed <= 0) | available.isNull() | (available <= 0)
    return cases([(bad, F.lit("unknown")), (available < needed, F.lit("short")), (available < needed + margin, F.lit("tight"))], F.lit("ample"))


def domain_path(domain: Column | str, relative: Column | str) -> Column:
    """A readable path of a backup entry: the application or group of AppDomain..., else the domain itself."""
    d, r = c(domain), c(relative)
    app = F.regexp_extract(d, r"^AppDomain(?:Group|Plugin)?-(.*)$", 1)
    top = F.when(app != "", F.concat(F.lit("Apps/"), app)).otherwise(F.regexp_replace(d, "Domain$", ""))
    return F.concat_ws("/", top, F.when(F.coalesce(r, F.lit("")) != "", r))


#: Schemes of remote addresses, and ways to mount an image that lies behind one: method and system.
REMOTE = ("smb", "cifs", "nfs", "iscsi", "http", "https", "ftp")
MOUNTS = {
    "smb": (("macOS Finder", "darwin"), ("Linux mount", "linux"), ("Windows Explorer", "windows")),
    "nfs": (("Linux mount", "linux"),),
    "iscsi": (("iSCSI initiator", "any"),),
}


def _scheme(url: Column | str) -> Column:
    return F.regexp_extract(c(url), r"^([a-z]+)://", 1)


def is_remote(url: Column | str) -> Column:
    return F.coalesce(_scheme(url).isin(*REMOTE), F.lit(False))


def mount_advice(url: Column | str) -> Column:
    """An array of (method, system) by which an address can be mounted; empty for others. cifs is another name of smb."""
    s = F.regexp_replace(_scheme(url), "^cifs$", "smb")
    ways = lambda rows: F.array(*[F.struct(F.lit(m).alias("method"), F.lit(o).alias("system")) for m, o in rows])
    return cases([(s == k, ways(rows)) for k, rows in MOUNTS.items()], F.expr("cast(array() as array<struct<method:string,system:string>>)"))


def byte_units(size: Column | str, letters: str = "KMGTPE") -> Column:
    """Bytes with one decimal of a 1024-based unit, as the progress of an image dump shows them; ties go to the even digit, as
    in printf. The last of the letters serves all larger sizes."""
    n = c(size).cast("long")
    tiers = []
    for i, letter in reversed(list(enumerate(letters, 1))):
        x = n / F.lit(float(1024**i))
        # a double of 1 or more is a whole number and a multiple of 2 ** -52: its digits follow from integers
        whole = F.floor(x)
        tenths = ((x - whole) * float(1 << 52)).cast("long") * 10
        digit = F.shiftright(tenths + ((1 << 51) - 1) + F.shiftright(tenths, 52) % 2, 52)
        text = F.concat((whole + F.when(digit == 10, 1).otherwise(0)).cast("string"), F.lit("."), (digit % 10).cast("string"), F.lit(f" {letter}B"))
        tiers.append((n >= 1024**i, text))
    return cases(tiers, F.concat(n.cast("string"), F.lit(" B")))


def speed(done: Column, seconds: Column) -> Column:
    """Whole bytes a second; 0 in the first tenth of a second."""
    return F.when(seconds > 0.1, F.floor(done / seconds)).otherwise(0).cast("long")


def eta(done: Column, whole: Column, per_second: Column) -> Column:
    """The time that is left, as text; ... while nothing is known of the speed."""
    left = F.greatest(whole - done, F.lit(0)) / per_second
    return F.when(per_second > 0, format_duration(left)).otherwise("...")


def percent_of(done: Column, whole: Column) -> Column:
    """Percent, from 0 to 100."""
    return F.when(whole > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), done * 100.0 / whole))).otherwise(0.0)
