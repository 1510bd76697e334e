"""Sources: JSON lines of labelled messages, web payloads, the headers of image files, and recognised lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.spans import bound

LABELLED = "id string, split string, label string, category string, channel string, sender_id string, claimed_sender string, known_contact boolean, text string"
PAYLOAD = "text string, channel string, sender_id string, claimed_sender string, known_contact string, trusted_sender string, ocr string"
OCR = "struct<lines:array<struct<text:string,confidence:double,bbox:array<double>>>>"


def read_labelled(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Labelled messages, one JSON object per line; blank lines are nothing."""
    d = spark.read.schema(LABELLED).json(path).where("id is not null")
    return d if split is None else d.where(F.col("split") == split)


def parse_payloads(requests: DataFrame, body: str = "payload", most_bytes: int = 64_000) -> DataFrame:
    """Adds code, error and the message's columns. The first fault counts: too large, not an object, channel, field types, lines."""
    raw = F.col(body)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), f"$.{name}", "variant"))
    p = F.from_json(raw, PAYLOAD)
    d = requests.withColumn("__p", p).withColumn("__ocr", F.from_json("__p.ocr", OCR))
    of = lambda name, *kinds: F.coalesce(kind(name).isin(*kinds, "VOID"), F.lit(True))  # noqa: E731  a field may be null or missing
    lines = F.col("__ocr.lines")
    wrong = {
        "channel must be sms, email or chat": ~F.coalesce(F.col("__p.channel"), F.lit("sms")).isin("sms", "email", "chat"),
        "sender_id must be a string": ~of("sender_id", "STRING"),
        "claimed_sender must be a string": ~of("claimed_sender", "STRING"),
        "known_contact must be a boolean": ~of("known_contact", "BOOLEAN"),
        "trusted_sender must be a boolean": ~of("trusted_sender", "BOOLEAN"),
        "ocr.lines must be a list": F.col("__p.ocr").isNotNull() & lines.isNull(),
        "too many OCR lines": F.size(lines) > 400,
        "each OCR line needs text": F.exists(lines, lambda l: l["text"].isNull()),
        "each OCR line needs bbox [x0, y0, x1, y1]": F.exists(lines, lambda l: F.coalesce(F.size(l["bbox"]) != 4, F.lit(True))),
        "text must be a string": F.col("__p.ocr").isNull() & ~of("text", "STRING"),
    }
    says = lambda code, error: F.struct(F.lit(code).alias("code"), F.lit(error).alias("error"))
    fault = F.when(F.octet_length(raw) > most_bytes, says(413, "body too large")).when(F.call_function("json_object_keys", raw).isNull(), says(400, "body must be a JSON object"))
    for error, test in wrong.items():
        fault = fault.when(test, says(400, error))
    field = lambda name: F.nullif(F.left(F.trim(f"__p.{name}"), F.lit(200)), F.lit(""))
    d = d.withColumn("__f", fault)
    return d.select(
        *requests.columns, F.coalesce("__f.code", F.lit(200)).alias("code"), F.col("__f.error").alias("error"), F.coalesce("__p.text", F.lit("")).alias("text"),
        F.coalesce("__p.channel", F.lit("sms")).alias("channel"), field("sender_id").alias("sender_id"), field("claimed_sender").alias("claimed_sender"),
        (F.col("__p.known_contact") == "true").alias("known_contact"), (F.col("__p.trusted_sender") == "true").alias("trusted_sender"), ocr_lines(lines).alias("lines"),
    )


def ocr_lines(lines: Column) -> Column:
    """Lines of a payload as boxes: texts of 1000 characters at most, percentages as shares, shares between 0 and 1."""
    share = lambda l: F.coalesce(F.when(l["confidence"] > 1, l["confidence"] / 100).otherwise(l["confidence"]), F.lit(0.0))
    at = lambda l, i: F.get(l["bbox"], F.lit(i))
    return F.transform(lines, lambda l: F.struct(F.left(l["text"], F.lit(1000)).alias("text"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share(l))).alias("confidence"), at(l, 0).alias("x0"), at(l, 1).alias("y0"), at(l, 2).alias("x1"), at(l, 3).alias("y1")))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


#: Segments of a file that are walked at most; a header that goes on beyond counts as corrupt.
SEGMENTS = 4096
# Bytes of formats in hex, and of a JPEG's markers: sizes, stand-alone ones, and those that end a header.
PNG_SIGN, JPEG_SIGN, RIFF, WEBP, EXIF_SIGN = "89504E470D0A1A0A", "FFD8FF", "52494646", "57454250", "457869660000"
SIZES = (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)
ALONE, ENDS, APP1 = (0x01, *range(0xD0, 0xD9)), (0xD9, 0xDA), 0xE1
ORIENTATION = 0x0112


def _hex(c: Column, at: Column, n) -> Column:
    return F.hex(F.substr(c, (at + 1).cast("int"), F.lit(n) if isinstance(n, int) else n.cast("int")))


def _number(c: Column, at: Column, n: int, little: bool = False) -> Column:
    """n bytes from a place (from 0) as a number; null where there are fewer."""
    digits = F.concat(*[_hex(c, at + i, 1) for i in reversed(range(n))]) if little else _hex(c, at, n)
    return F.when(F.length(digits) == 2 * n, F.conv(digits, 16, 10).cast("long"))


def orientation(tiff: Column) -> Column:
    """The camera's orientation (1 to 8) in the first directory of EXIF data; null where there is none. Data may begin with its own sign."""

    def of(c: Column) -> Column:
        little = _hex(c, F.lit(0), 2) == "4949"
        number = lambda at, n: F.when(little, _number(c, at, n, True)).otherwise(_number(c, at, n))
        start = number(F.lit(4), 4)
        many = F.least(F.coalesce(number(start, 2), F.lit(0)), (F.octet_length(c) / 12).cast("long"))
        entries = F.transform(F.sequence(F.lit(0), F.greatest(many - 1, F.lit(0)).cast("int")), lambda i: start + 2 + 12 * i)
        value = F.get(F.filter(F.transform(F.filter(entries, lambda e: number(e, 2) == ORIENTATION), lambda e: number(e + 8, 2)), lambda v: v.between(1, 8)), F.lit(0))
        return F.when((many > 0) & (number(F.lit(2), 2) == 42), value.cast("int"))

    signed = _hex(tiff, F.lit(0), 6) == EXIF_SIGN
    return bound(F.when(signed, F.substr(tiff, F.lit(7), F.octet_length(tiff))).otherwise(tiff), of)


_FOUND = "struct<at:bigint,width:bigint,height:bigint,turn:int,over:boolean>"


def _walk(c: Column, start: int, step) -> Column:
    """A fold over the segments of a file: step gets the bytes and what was found so far, and tells what is found with one more."""
    begin = F.struct(F.lit(start).cast("long").alias("at"), F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"), F.lit(None).cast("int").alias("turn"), F.lit(False).alias("over"))
    most = F.least(F.lit(SEGMENTS), (F.octet_length(c) / 4).cast("int") + 1)
    return F.aggregate(F.sequence(F.lit(1), most), begin, lambda a, _: F.when(a["over"], a).otherwise(step(c, a)).cast(_FOUND))


def _next(a: Column, at=None, width=None, height=None, turn=None, over: bool = False) -> Column:
    pick = lambda name, new: (a[name] if new is None else F.coalesce(a[name], new)).alias(name)  # noqa: E731  the first that is found counts
    return F.struct((a["at"] if at is None else at).cast("long").alias("at"), pick("width", width), pick("height", height), pick("turn", turn), F.lit(over).alias("over"))


def _jpeg(c: Column, a: Column) -> Column:
    at, mark = a["at"], _number(c, a["at"] + 1, 1)
    size = _number(c, at + 2, 2)
    to = at + 2 + size
    exif = (mark == APP1) & (_hex(c, at + 4, 6) == EXIF_SIGN)
    return (
        F.when(F.coalesce(_number(c, at, 1) != 0xFF, F.lit(True)) | mark.isNull() | mark.isin(*ENDS), _next(a, over=True))
        .when(mark == 0xFF, _next(a, at + 1)).when(mark.isin(*ALONE), _next(a, at + 2))
        .when(mark.isin(*SIZES), _next(a, to, _number(c, at + 7, 2), _number(c, at + 5, 2), over=True))
        .when(F.coalesce(size < 2, F.lit(True)), _next(a, over=True))
        .when(exif, _next(a, to, turn=orientation(F.substr(c, (at + 5).cast("int"), (size - 2).cast("int"))))).otherwise(_next(a, to))
    )


def _webp(c: Column, a: Column) -> Column:
    at, name, size = a["at"], _hex(c, a["at"], 4), _number(c, a["at"] + 4, 4, True)
    data, to = at + 8, at + 8 + size + size % 2
    few = lambda place: _number(c, place, 2, True).bitwiseAND(F.lit(0x3FFF))
    bits = _number(c, data + 1, 4, True)
    packed = lambda shift: F.shiftright(bits, shift).bitwiseAND(F.lit(0x3FFF)) + 1
    return (
        F.when(size.isNull(), _next(a, over=True))
        .when(name == "56503858", _next(a, to, _number(c, data + 4, 3, True) + 1, _number(c, data + 7, 3, True) + 1))
        .when((name == "56503820") & (_hex(c, data + 3, 3) == "9D012A"), _next(a, to, few(data + 6), few(data + 8)))
        .when((name == "5650384C") & (_hex(c, data, 1) == "2F"), _next(a, to, packed(0), packed(14)))
        .when(name == "45584946", _next(a, to, turn=orientation(F.substr(c, (data + 1).cast("int"), size.cast("int"))))).otherwise(_next(a, to))
    )


def _png(c: Column, a: Column) -> Column:
    at, size, name = a["at"], _number(c, a["at"], 4), _hex(c, a["at"] + 4, 4)
    to = at + 12 + size
    return (
        F.when(size.isNull() | (name == "49454E44"), _next(a, over=True))
        .when((name == "49484452") & (at == 8), _next(a, to, _number(c, at + 8, 4), _number(c, at + 12, 4)))
        .when(name == "65584966", _next(a, to, turn=orientation(F.substr(c, (at + 9).cast("int"), size.cast("int"))))).otherwise(_next(a, to))
    )


def judge_images(images: DataFrame, most_bytes: int = 8_000_000, most_pixels: int = 40_000_000, most_side: int = 2000, content: str = "content") -> DataFrame:
    """Adds format, width, height, orientation (1 to 8; null: none), shown_width and shown_height, and flag (null: fine), from the bytes alone.

    PNG, JPEG and WEBP are walked segment by segment to their sizes and to the camera's orientation. An image is shown turned upright and, if a
    side is longer than most_side, smaller. Flags: empty, too large, of no known format, corrupt (no size in it), too many pixels."""
    c = F.col(content)
    size = F.coalesce(F.octet_length(c), F.lit(0))
    head = F.hex(F.substring(c, 1, 12))
    kind = F.when(head.startswith(PNG_SIGN), "PNG").when(head.startswith(JPEG_SIGN), "JPEG").when(head.startswith(RIFF) & head.endswith(WEBP), "WEBP")
    fine = (size > 0) & (size <= most_bytes)
    walks = lambda b: F.when(F.col("format") == "PNG", _walk(b, 8, _png)).when(F.col("format") == "JPEG", _walk(b, 2, _jpeg)).when(F.col("format") == "WEBP", _walk(b, 12, _webp))
    d = images.withColumn("format", kind).withColumn("__w", F.when(fine & F.col("format").isNotNull(), bound(c, walks)))
    whole = (F.col("__w.width") > 0) & (F.col("__w.height") > 0)
    d = d.withColumns({"width": F.when(whole, F.col("__w.width")), "height": F.when(whole, F.col("__w.height")), "orientation": F.col("__w.turn")})
    turned = F.coalesce(F.col("orientation") >= 5, F.lit(False))
    w, h = (F.when(turned, F.col(b)).otherwise(F.col(a)) for a, b in (("width", "height"), ("height", "width")))
    share = F.least(F.lit(1.0), F.lit(float(most_side)) / F.greatest(w, h))
    d = d.withColumns({f"shown_{n}": F.greatest(F.lit(1), F.round(v * share)).cast("long") for n, v in (("width", w), ("height", h))})
    flag = F.when(size == 0, "empty_image").when(size > most_bytes, "image_too_large").when(F.col("format").isNull(), "not_an_image").when(F.col("width").isNull(), "corrupt_image").when(F.col("width") * F.col("height") > most_pixels, "image_too_many_pixels")
    return d.withColumn("flag", flag).withColumns({f"shown_{n}": F.when(flag.isNull(), F.col(f"shown_{n}")) for n in ("width", "height")}).drop("__w")
