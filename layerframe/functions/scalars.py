"""Scalar functions as native column expressions."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F


def align_down(x: Column, unit: int) -> Column:
    return x - F.pmod(x, F.lit(unit))


def align_up(x: Column, unit: int) -> Column:
    return align_down(x + (unit - 1), unit)


def to_sectors(x: Column) -> Column:
    return F.shiftright(x, 9)


def to_bytes(x: Column) -> Column:
    return F.shiftleft(x, 9)


def clean_path(path: Column) -> Column:
    """Lexical clean-up: repeated slashes, . and .. go; a rooted path never climbs above its root; an empty result is '.'."""
    rooted = path.startswith("/")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        can_climb = (F.size(acc) > 0) & (F.when(F.size(acc) > 0, last) != "..")
        up = F.when(can_climb, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(rooted, acc).otherwise(F.array_append(acc, ".."))
        return F.when((x == "") | (x == "."), acc).when(x == "..", up).otherwise(F.array_append(acc, x))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.array_join(parts, "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def remove_last_slash(path: Column) -> Column:
    return F.regexp_replace(path, "(?<=.)/$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """With its slash, as in a prefix; empty for a bare name."""
    return F.regexp_extract(path, "^(.*/)?", 0)


def octal(field: Column) -> Column:
    """An octal header field, padded by spaces or zero bytes."""
    digits = F.regexp_extract(field, "^[ \\x00]*([0-7]*)", 1)
    return F.coalesce(F.conv(F.when(digits != "", digits).otherwise("0"), 8, 10).cast("long"), F.lit(0))


#: File type bits by tar type flag (fixed values of the format).
TYPE_BITS = {"2": 0o120000, "3": 0o020000, "4": 0o060000, "5": 0o040000, "6": 0o010000}
REGULAR, DIRECTORY, TYPE_MASK = 0o100000, 0o040000, 0o170000


def mode_of(mode: Column, typeflag: Column, name: Column) -> Column:
    """The mode with its file type: from the field, else from the type flag; an old regular entry that ends in / is a directory."""
    kind = F.lit(REGULAR)
    for flag, bits in TYPE_BITS.items():
        kind = F.when(typeflag == flag, F.lit(bits)).otherwise(kind)
    kind = F.when((typeflag == "\x00") & name.endswith("/"), F.lit(DIRECTORY)).otherwise(kind)
    return F.when(mode.bitwiseAND(F.lit(TYPE_MASK).cast("long")) != 0, mode).otherwise(mode.bitwiseOR(kind.cast("long")))


def effective_name(pax: Column, gnu: Column, magic: Column, prefix: Column, name: Column) -> Column:
    """PAX before GNU before prefix/name (POSIX archives only) before name; cleaned."""
    plain = F.when(magic.startswith("ustar") & (prefix != ""), F.concat_ws("/", F.substring(prefix, 1, 155), F.substring(name, 1, 100))).otherwise(F.substring(name, 1, 100))
    return clean_path(F.coalesce(pax, gnu, plain))


def trim_char(s: Column, ch: str = " ") -> Column:
    return F.btrim(s, F.lit(ch))


def query_params(query: Column) -> Column:
    """key=value&... as a map, both decoded; a key alone has an empty value; the last of equal keys wins."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    key = lambda p: F.url_decode(F.substring_index(p, "=", 1))
    val = lambda p: F.url_decode(F.when(F.instr(p, "=") > 0, F.regexp_extract(p, "(?s)=(.*)$", 1)).otherwise(""))
    rows = F.transform(pairs, lambda p: F.struct(key(p).alias("key"), val(p).alias("value")))
    last = F.filter(rows, lambda r, i: ~F.exists(F.slice(rows, i + 2, F.size(rows)), lambda q: q["key"] == r["key"]))
    return F.map_from_entries(last)


def basic_credentials(auth: Column) -> Column:
    """struct(username, password) of a base64 user:password."""
    text = F.decode(F.unbase64(auth), "UTF-8")
    return F.struct(F.substring_index(text, ":", 1).alias("username"), F.regexp_extract(text, "(?s):(.*)$", 1).alias("password"))


def blob_segments(url: Column) -> Column:
    """Host and name space of an http(s) blob url: the segment behind the host (v2) and the last one are left out."""
    words = F.split(F.regexp_replace(url, "^https?://", ""), "/")
    kept = F.concat(F.slice(words, 1, 1), F.when(F.size(words) > 4, F.slice(words, 3, F.size(words) - 4)).otherwise(F.array().cast("array<string>")))
    return F.when(url.rlike("^https?://[^/]*/"), kept)


def segment_prefixes(segments: Column) -> Column:
    return F.transform(segments, lambda x, i: F.array_join(F.slice(segments, 1, i + 1), "/"))


def challenge_map(header: Column) -> Column:
    """key="value",... of an authentication challenge as a map."""
    pairs = F.split(F.regexp_replace(header, '",', '";'), ";")
    return F.map_from_entries(F.transform(F.filter(pairs, lambda p: F.instr(p, "=") > 0), lambda p: F.struct(
        F.substring_index(p, "=", 1).alias("key"), F.btrim(F.regexp_extract(p, "(?s)=(.*)$", 1), F.lit('"')).alias("value"))))


def config_and_device(text: Column) -> Column:
    """struct(config, dev_id) of `config;dev_id`; without ; there is no device."""
    return F.struct(F.substring_index(text, ";", 1).alias("config"), F.when(F.instr(text, ";") > 0, F.regexp_extract(text, ";(.*)$", 1)).otherwise("").alias("dev_id"))


def get_bit(flags: Column, shift: int) -> Column:
    return flags.bitwiseAND(F.lit(1 << shift)) != 0


def set_bit(flags: Column, shift: int) -> Column:
    return flags.bitwiseOR(F.lit(1 << shift))


def clear_bit(flags: Column, shift: int) -> Column:
    return flags.bitwiseAND(F.lit(~(1 << shift)))


def is_uuid(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def digest(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def big_endian(data: Column, at: int, size: int) -> Column:
    """An unsigned number of `size` bytes (1 to 7) at byte `at`."""
    return F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("long")


#: Messages by error number (fixed values).
ERRORS = {1: "Authentication failed", 13: "Authentication failed", 107: "Connection failed", 110: "Get meta timedout", 2: "No such file or directory", 16: "Too many requests", 5: "Unexpected response"}
#: Numbers below this one have a text of the system's own.
MOST_ERRORS = 134


def error_message(eno: Column) -> Column:
    """The message of an error number; the system's text where there is none of our own."""
    texts = F.array(*[F.lit(ERRORS.get(i, os.strerror(i))) for i in range(MOST_ERRORS)])
    return F.when((eno >= 0) & (eno < MOST_ERRORS), F.get(texts, eno.cast("int"))).otherwise(F.concat(F.lit("Unknown error "), eno.cast("string")))


def pax_record(key: Column, value: Column) -> Column:
    """`len key=value\\n` with a length that counts its own digits."""
    body = F.concat(F.lit(" "), key, F.lit("="), value, F.lit("\n"))
    n = F.octet_length(body)
    one = n + F.length(n.cast("string"))
    size = n + F.length(one.cast("string"))
    return F.concat(size.cast("string"), body)


def clamp_read(offset: Column, count: Column, size: Column) -> Column:
    """Bytes that a read returns: -1 for a negative offset, less at the end, none behind it."""
    return F.when(offset < 0, F.lit(-1)).when(offset >= size, F.lit(0)).otherwise(F.least(count, size - offset)).cast("long")


def resize_action(current: Column, target: Column, resize_fs: Column, read_only: Column) -> Column:
    """Steps in order, or the refusal."""
    return (
        F.when(read_only, "refused: read-only")
        .when((target == current) & ~resize_fs, "none")
        .when((target < current) & ~resize_fs, "refused: shrink without filesystem")
        .when(target > current, F.when(resize_fs, "device,filesystem").otherwise("device"))
        .when(target < current, "filesystem,device").otherwise("filesystem")
    )


def trace_mode(exists: Column, size: Column) -> Column:
    return F.when(~exists, "disabled").when(size == 0, "record").otherwise("replay")


def watermark(capacity: Column, reserve: int = 50 << 30) -> Column:
    """Bytes a cache may fill: nine tenths, or all but the reserve where that is more."""
    return F.greatest(F.floor(capacity * 9 / 10).cast("long"), (capacity - reserve).cast("long"))
