"""Primary headers of frame files: read by blocks up to END, parsed into cards, summarised, grouped.

``header_blocks`` is a data source: ``spark.read.format("header_blocks").load(root)`` lists the frames below a
folder and reads each file in blocks of 2,880 bytes until the END card, so pixels are never read and the time
of a file does not depend on its size. The other functions take such headers, or any column of header bytes.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.audit import with_group_key
from .files import LIGHT_DIRS

C = F.col
BLOCK, CARD = 2880, 80
SUFFIXES = (".fit", ".fits", ".fts")  # fixed values


def read_header(stream) -> bytes:
    """Blocks of an open file up to the one with the END card; all of them where it is missing."""
    parts = []
    while block := stream.read(BLOCK):
        parts.append(block)
        if any(block[at : at + 8] == b"END     " for at in range(0, len(block), CARD)):
            break
    return b"".join(parts)


class _Files(InputPartition):
    def __init__(self, files: Sequence[tuple[str, int]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.per = options["path"], int(options.get("filesPerPartition", "256"))
        self.suffixes = tuple(options.get("suffixes", ",".join(SUFFIXES)).lower().split(","))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.root)
        found = system.get_file_info(fs.FileSelector(base, recursive=True))
        files = sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and i.path.lower().endswith(self.suffixes))
        return [_Files(files[at : at + self.per]) for at in range(0, len(files), self.per)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.root)
        for path, size in partition.files:
            with system.open_input_file(path) as f:
                yield path[len(base.rstrip("/")) + 1 :], size, read_header(f)


class HeaderBlocks(DataSource):
    """path (relative to the root), bytes, content (the header). Options: suffixes, filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "header_blocks"

    def schema(self) -> str:
        return "path string, bytes long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_headers(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(HeaderBlocks)
    return spark.read.format("header_blocks").options(**options).load(root)


def with_cards(files: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns of files(content BINARY or STRING) and ``_cards``: the 80-byte cards up to END, all where END is missing.

    A byte beyond ASCII is kept as one Latin-1 character and spoils its own card only. Each step is a column of
    its own, so that the bytes are decoded and cut once; what follows END is left out before it is cut.
    """
    f = files.select(*keep, F.decode(F.coalesce(C("content").cast("binary"), F.lit(b"")), "ISO-8859-1").alias("_text"))
    f = f.select(*keep, "_text", F.instr("_text", "END     ").alias("_at"))
    # the first END that stands at a card's begin; where these letters stand elsewhere before it, cards are compared
    f = f.select(*keep, F.when((C("_at") > 0) & (C("_at") % CARD == 1), F.substring("_text", F.lit(1), C("_at") - 1)).otherwise(C("_text")).alias("_text"))
    f = f.select(*keep, F.regexp_extract_all("_text", F.lit("(?s).{80}"), F.lit(0)).alias("_cards"))
    f = f.select(*keep, "_cards", F.array_position(F.transform("_cards", lambda c: c.startswith("END     ")), F.lit(True)).cast("int").alias("_end"))
    return f.select(*keep, F.when(C("_end") > 0, F.slice("_cards", F.lit(1), C("_end") - 1)).otherwise(C("_cards")).alias("_cards"))


def card_parts(c: Column) -> dict[str, Column]:
    return {"key": F.upper(F.trim(F.substring(c, 1, 8))), "card": c, "valued": F.substring(c, 9, 2) == "= ", "raw": F.substr(c, F.lit(11))}


def header_cards(files: DataFrame, key: str = "frame_id") -> DataFrame:
    """One row per 80-byte card of the header up to END, whatever its length. files(key, content BINARY or STRING)."""
    rows = with_cards(files, [key]).select(key, F.posexplode("_cards").alias("pos", "card"))
    return rows.select(key, "pos", *[c.alias(n) for n, c in card_parts(C("card")).items()])


def card_value(raw: Column) -> dict[str, Column]:
    """Typed value of the text after ``= ``: string, boolean or number."""
    v = F.trim(raw)
    quoted = v.startswith("'")
    # the closing quote is the first single one; doubled quotes stand for one
    inner = F.regexp_extract(v, r"^'((?:[^']|'')*)", 1)
    text = F.trim(F.replace(inner, F.lit("''"), F.lit("'")))
    bare = F.trim(F.element_at(F.split(v, "/"), 1))
    num = F.when(bare.rlike(_NUMBER), F.replace(F.upper(bare), F.lit("D"), F.lit("E")).try_cast("double"))
    flag = F.when(bare.isin("T", "F"), bare == "T")
    return {
        "v_str": F.when(quoted, text).when(num.isNull() & flag.isNull(), bare),
        "v_num": F.when(~quoted, num), "v_bool": F.when(~quoted, flag)}


def typed_cards(cards: DataFrame, key: str = "frame_id") -> DataFrame:
    """Value cards with their typed columns."""
    v = cards.where(C("valued") & (C("key") != ""))
    return v.select(key, "pos", "key", *[c.alias(n) for n, c in card_value(C("raw")).items()])


def history_text(cards: DataFrame, key: str = "frame_id") -> DataFrame:
    """Lower-case ``KEY value`` text of all cards of each file, in card order."""
    hist = C("key").isin("HISTORY", "COMMENT")
    value = F.when(hist, F.trim(F.substr("card", F.lit(9)))).when(C("valued"), F.trim(F.element_at(F.split("raw", "/"), 1))).otherwise("")
    rows = cards.select(key, "pos", F.concat_ws(" ", "key", value).alias("t"), value.alias("v")).where(C("v") != "")
    # one header per array
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("p"))
    return g.select(key, F.lower(F.array_join(F.transform("p", lambda s: s["t"]), " ")).alias("text"))


# Keys that say the same, the first one that is there and not blank counts (fixed values).
OBJECT, FILTER = ("OBJECT", "OBJNAME", "TARGET"), ("FILTER", "FILTER1", "FILTER2")
CAMERA, DEVICE = ("INSTRUME", "CAMERA", "DETECTOR"), ("TELESCOP", "INSTRUME", "CAMERA", "DETECTOR")
EXPOSURE, STACKED = ("EXPTIME", "EXPOSURE", "EXP_TIME"), ("STACKCNT", "NCOMBINE", "NFRAMES", "FRAMES")
_NUMBERS = {
    "gain": ("GAIN", "EGAIN", "CCDGAIN"), "sensor_celsius": ("CCD-TEMP", "CCDTEMP", "SENSORT", "SENSOR_T"),
    "focal_mm": ("FOCALLEN", "FOCAL", "FOCLEN"), "pixel_x_um": ("XPIXSZ", "PIXSIZE"), "pixel_y_um": ("YPIXSZ",)}
_TEXTS = {
    "object": OBJECT, "observed": ("DATE-OBS", "DATEOBS", "DATE"), "image_type": ("IMAGETYP", "FRAMETYP", "FRAME"),
    "ra": ("OBJCTRA", "RA", "CRVAL1"), "dec": ("OBJCTDEC", "DEC", "CRVAL2"), "bayer": ("BAYERPAT", "BAYERPATTERN"), "software": ("CREATOR", "SWCREATE", "PROGRAM")}
_SIZES = ("NAXIS1", "NAXIS2", "NAXIS3", "BITPIX", "XBINNING", "XBIN", "BINNING", "YBINNING", "YBIN")
_TYPES = {8: "uint8", 16: "uint16", 32: "int32", 64: "int64", -32: "float32", -64: "float64"}


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([EeDd][+-]?\d+)?$"


def clean(text: Column) -> Column:
    """White space as single spaces, ends trimmed; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.replace(text, F.lit("\0"), F.lit("")), r"\s+", " ")), F.lit(""))


def last_values(files: DataFrame, keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns of files(content), ``n`` different keys, ``simple``, and for each key a struct (text, num)
    of its last card. A header is one row from the file to the result: nothing is exploded or shuffled."""
    # each step names what the next one uses more than once
    def cut(c: Column) -> Column:
        part = card_parts(c)
        v = F.trim(part["raw"])
        return F.struct(part["key"].alias("key"), v.alias("v"), F.trim(F.element_at(F.split(v, "/"), 1)).alias("bare"))

    def parsed(c: Column) -> Column:
        quoted = c["v"].startswith("'")
        text = F.trim(F.replace(F.regexp_extract(c["v"], r"^'((?:[^']|'')*)", 1), F.lit("''"), F.lit("'")))
        return F.struct(c["key"].alias("key"), F.when(quoted, text).otherwise(c["bare"]).alias("text"), (~quoted & c["bare"].isin("T", "F")).alias("flag"), (~quoted & c["bare"].rlike(_NUMBER)).alias("number"))

    def numbered(c: Column) -> Column:
        # a string that reads as a number counts as one where a number is asked for
        num = F.when(~c["flag"], F.replace(F.upper(c["text"]), F.lit("D"), F.lit("E")).try_cast("double"))
        return F.struct(c["key"].alias("key"), c["text"].alias("text"), c["flag"].alias("flag"), c["number"].alias("number"), num.alias("num"))

    def value(c: Column) -> Column:
        whole = (c["num"] == F.floor(c["num"])) & (F.abs(c["num"]) < 1e15)
        number = F.when(whole, c["num"].cast("long").cast("string")).otherwise(c["num"].cast("string"))
        text = F.when(c["flag"], F.when(c["text"] == "T", "True").otherwise("False")).when(c["number"], number).otherwise(c["text"])
        return F.struct(c["key"].alias("key"), F.struct(clean(text).alias("text"), c["num"].alias("num")).alias("v"))

    f = with_cards(files, keep)
    f = f.select(*keep, F.filter("_cards", lambda c: card_parts(c)["valued"] & (F.substring(c, 1, 8) != " " * 8)).alias("_cards"))
    f = f.select(*keep, "_cards", F.transform("_cards", lambda c: card_parts(c)["key"]).alias("_names"))
    asked = F.filter("_cards", lambda c: card_parts(c)["key"].isin(list(keys)))
    values = F.transform(F.transform(F.transform(F.transform(asked, cut), parsed), numbered), value)
    f = f.select(*keep, F.array_distinct("_names").alias("_names"), values.alias("_values"))
    held = F.array_distinct(F.transform("_values", lambda x: x["key"]))
    last = F.map_from_arrays(held, F.transform(held, lambda name: F.try_element_at(F.filter("_values", lambda x: x["key"] == name), F.lit(-1))["v"]))
    f = f.select(*keep, F.size("_names").alias("n"), F.array_contains("_names", "SIMPLE").alias("simple"), last.alias("_last"))
    return f.select(*keep, "n", "simple", *[F.try_element_at("_last", F.lit(k)).alias(k) for k in keys])


def _named(keys: Sequence[str]) -> Column:
    """Different names of several keys, in order, case ignored."""
    names = F.filter(F.array(*[C(f"`{k}`.text") for k in keys]), lambda x: x.isNotNull())
    first = F.filter(names, lambda x, i: F.array_position(F.transform(names, F.lower), F.lower(x)) == i + 1)
    return F.nullif(F.array_join(first, " · "), F.lit(""))


def _first(keys: Sequence[str], field: str) -> Column:
    """Of the first key whose text is not blank."""
    return F.coalesce(*[F.when(C(f"`{k}`.text").isNotNull(), C(f"`{k}`")) for k in keys])[field]


def _count(c: Column) -> Column:
    return F.when((c > 0) & (c == F.floor(c)) & (c < 2**31), c.cast("int"))


def header_summary(files: DataFrame, key: str = "frame_id") -> DataFrame:
    """What the primary header says of each frame of files(key, content).

    Names of devices and filters of several keys are joined; of keys that say the same the first one that is
    not blank counts; the last card of a repeated key wins. Without SIMPLE the status is ``unavailable``.
    """
    keys = list(dict.fromkeys([*DEVICE, *FILTER, *EXPOSURE, *STACKED, *_SIZES, *(k for ks in [*_NUMBERS.values(), *_TEXTS.values()] for k in ks)]))
    s = last_values(files, keys, [key])
    size = lambda k: _count(C(f"`{k}`.num"))
    kind = F.coalesce(*[F.when(C("BITPIX.num") == n, t) for n, t in _TYPES.items()])
    x = _count(_first(("XBINNING", "XBIN", "BINNING"), "num"))
    stacked, exposure = _count(_first(STACKED, "num")), _first(EXPOSURE, "num")
    return s.select(
        key, F.when(C("simple"), "ready").otherwise("unavailable").alias("status"), C("n").alias("fields"),
        size("NAXIS1").alias("width"), size("NAXIS2").alias("height"), F.coalesce(size("NAXIS3"), F.lit(1)).alias("channels"), kind.alias("dtype"),
        exposure.alias("exposure"), stacked.alias("stack_count"), (exposure.isNotNull() & (F.coalesce(stacked, F.lit(1)) > 1)).alias("per_frame"),
        _named(FILTER).alias("filter"), _named(DEVICE).alias("device"), C("DETECTOR.text").alias("sensor"),
        x.alias("bin_x"), F.when(x.isNotNull(), F.coalesce(_count(_first(("YBINNING", "YBIN"), "num")), x)).alias("bin_y"),
        *[_first(ks, "num").alias(n) for n, ks in _NUMBERS.items()], *[_first(ks, "text").alias(n) for n, ks in _TEXTS.items()])


# Words of a file name that tell its filter (fixed values).
_FILTER_WORDS = ((r"\b(?:lp|light pollution)\b", "Seestar LP"), (r"\b(?:ha ?oiii|dual ?narrowband|duoband)\b", "dual narrowband"), (r"\b(?:no ?filter|clear)\b", "no filter"))


def light_identity(files: DataFrame, root_name: str = "", key: str = "path") -> DataFrame:
    """path, bytes, target, filter, camera, geometry of light frames, from their headers and else from their paths.

    files(path relative to the root, bytes, content). ``root_name`` is the name of the folder that holds
    the paths, or of the one above it where it is itself called lights.
    """
    keys = list(dict.fromkeys([*OBJECT, *FILTER, *CAMERA, "NAXIS1", "NAXIS2", "XBINNING", "XBIN", "YBINNING", "YBIN"]))
    s = last_values(files, keys, [key, "bytes"])
    dirs = F.filter(F.split(F.regexp_replace(key, r"/?[^/]*$", ""), "/"), lambda p: p != "")
    lit = F.filter(F.sequence(F.lit(1), F.greatest(F.size(dirs), F.lit(1))), lambda i: (i > 1) & F.coalesce(F.lower(F.trim(F.get(dirs, i - 1))).isin(*LIGHT_DIRS), F.lit(False)))
    place = F.coalesce(clean(F.get(dirs, F.get(lit, F.lit(0)) - 2)), F.lit(" ".join(root_name.split()) or "unknown"))
    stem = F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(key, "^.*/", ""), r"\.[^.]*$", "")), "[^a-z0-9]+", " ")
    hint = F.coalesce(*[F.when(stem.rlike(p), F.lit(v)) for p, v in _FILTER_WORDS], F.lit("unknown"))
    whole = lambda c: c.cast("long").cast("string")
    num = lambda k: C(f"`{k}`.num")
    # a key that is there but holds no number gives no geometry
    given = lambda *ks: F.coalesce(*[C(f"`{k}`") for k in ks])
    bx = F.when(given("XBINNING", "XBIN").isNull(), F.lit(1.0)).otherwise(given("XBINNING", "XBIN")["num"])
    by = F.when(given("YBINNING", "YBIN").isNull(), bx).otherwise(given("YBINNING", "YBIN")["num"])
    geometry = F.concat(whole(num("NAXIS1")), F.lit("x"), whole(num("NAXIS2")), F.lit("@"), whole(bx), F.lit("x"), whole(by))
    return s.select(key, "bytes", F.coalesce(_first(OBJECT, "text"), place).alias("target"), F.coalesce(_first(FILTER, "text"), hint).alias("filter"), F.coalesce(_first(CAMERA, "text"), F.lit("unknown")).alias("camera"), F.coalesce(geometry, F.lit("unknown")).alias("geometry"))


def light_group_files(frames: DataFrame, path: str = "path") -> DataFrame:
    """Members of the groups of light frames: group_key, path, bytes.

    One row per file, so a group of any size is never one value nor sorted by one task.
    """
    return with_group_key(frames).select("group_key", path, "bytes")
