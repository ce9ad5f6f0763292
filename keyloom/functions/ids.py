"""Object ids: stable hashing to shards, the id grammar, ownership text, and small scalar rules. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHARDS = 8192
# FNV-1a of 32 bits.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
# Offset and prime of the 64-bit seeds.
SEED_OFFSET, SEED_PRIME = 1469598103934665603, 1099511628211
LOW = 0xFFFFFFFF


def utf8_bytes(text: Column) -> Column:
    """The values of the UTF-8 bytes of a text, as an array of longs."""
    plain = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")  # one character a byte
    return F.when(plain == "", F.array().cast("array<long>")).otherwise(F.transform(F.split(plain, ""), lambda c: F.ascii(c).cast("long")))


def fnv1a32(text: Column) -> Column:
    """FNV-1a of 32 bits over UTF-8 bytes, as a long."""
    return F.aggregate(utf8_bytes(text), F.lit(FNV_OFFSET).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(LOW)))


def fnv1a64(text: Column) -> Column:
    """FNV-1a of 64 bits from SEED_OFFSET, as a signed long. Two halves of 32 bits keep every product in range."""
    high, low = SEED_OFFSET >> 32, SEED_OFFSET & LOW
    by_high, by_low = SEED_PRIME >> 32, SEED_PRIME & LOW

    def step(h, b):
        at = h["low"].bitwiseXOR(b)
        down = at * by_low
        return F.struct((h["high"] * by_low + at * by_high + F.shiftright(down, 32)).bitwiseAND(F.lit(LOW)).alias("high"), down.bitwiseAND(F.lit(LOW)).alias("low"))

    start = F.struct(F.lit(high).cast("long").alias("high"), F.lit(low).cast("long").alias("low"))
    return F.aggregate(utf8_bytes(text), start, step, lambda h: F.shiftleft(h["high"], 32).bitwiseOR(h["low"]))


def fixed_shard(object_id: Column) -> Column:
    """The number of a `shard#<number>/...` id; null for other ids and malformed numbers. Sign and leading zeros are allowed."""
    number = F.regexp_extract(object_id, r"^shard#([+-]?[0-9]+)/", 1)
    return F.when(number != "", number.try_cast("long"))


def shard_id(object_id: Column, n: int = SHARDS) -> Column:
    """The shard of an id: its fixed shard if that is in range, else the hash of the whole id."""
    fixed = fixed_shard(object_id)
    return F.when(fixed.between(0, n - 1), fixed).otherwise(fnv1a32(object_id) % n)


def parse(object_id: Column) -> dict[str, Column]:
    """kind, shard, node, part and error of an id."""
    slash = F.instr(object_id, "/")
    sharded = object_id.startswith("shard#")
    fixed = fixed_shard(object_id)
    error = (
        F.when(object_id == "", "empty id")
        .when(sharded & (slash == 0), "shard id without slash")
        .when(sharded & fixed.isNull(), "bad shard number")
        .when(~sharded & (slash == 1), "empty node")
    )
    kind = F.when(error.isNotNull(), None).when(sharded, "shard").when(slash > 0, "node").otherwise("regular")
    after = F.expr("substring(object_id, instr(object_id, '/') + 1)")
    return {
        "kind": kind,
        "shard": F.when(kind == "shard", fixed),
        "node": F.when(kind == "node", F.substring_index(object_id, "/", 1)),
        "part": F.when(kind.isin("shard", "node"), after),
        "error": error,
    }


def trim(text: Column) -> Column:
    """A text without Unicode white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def parse_owner(value: Column) -> dict[str, Column]:
    """target, current and flags (joined by |) of `target,current,f=flag...`: flags may stand anywhere, white space is cut."""
    parts = F.transform(F.split(value, ","), trim)
    plain = F.filter(parts, lambda p: ~p.startswith("f="))
    flags = F.filter(F.transform(F.filter(parts, lambda p: p.startswith("f=")), lambda p: trim(p.substr(F.lit(3), F.length(p)))), lambda p: p != "")
    return {"target": F.coalesce(F.get(plain, F.lit(0)), F.lit("")), "current": F.coalesce(F.get(plain, F.lit(1)), F.lit("")), "flags": F.array_join(flags, "|")}


def format_owner(target: Column, current: Column, flags: Column) -> Column:
    """The text of target, current and an array of flags; blank flags are left out."""
    marks = F.transform(F.filter(F.transform(flags, trim), lambda f: f != ""), lambda f: F.concat(F.lit("f="), f))
    return F.array_join(F.concat(F.array(target, current), marks), ",")


def with_flag(flags: Column, flag: str, on: Column) -> Column:
    """The flags without `flag`, and with it at the end where `on` holds."""
    rest = F.array_remove(flags, flag)
    return F.when(on, F.array_append(rest, F.lit(flag))).otherwise(rest)


def client_parts(client: Column) -> dict[str, Column]:
    """gate and unique id of `gate/id`, cut at the first slash; both null unless both are there."""
    parts = F.split(client, "/", 2)
    whole = (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != "")
    return {"gate": F.when(whole, F.get(parts, F.lit(0))), "unique": F.when(whole, F.get(parts, F.lit(1)))}


def after_prefix(text: Column, n: int) -> Column:
    """A text without its first `n` characters; null if it has fewer."""
    return F.when(F.length(text) >= n, text.substr(F.lit(n + 1), F.length(text)))


def call_path(path: Column) -> dict[str, Column]:
    """type, id, method and error code of `type/id/method`, cut at the first two slashes."""
    parts = F.split(path, "/", 3)
    kind, name, method = (F.get(parts, F.lit(i)) for i in range(3))
    error = F.when(F.size(parts) < 3, "INVALID_PATH").when((kind == "") | (name == "") | (method == ""), "INVALID_PARAMETERS")
    return {"type": F.when(error.isNull(), kind), "id": F.when(error.isNull(), name), "method": F.when(error.isNull(), method), "error": error}


def event_frame(event: Column, data: Column) -> Column:
    """A server-sent event of one data line."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def positive_or(value: Column, default: Column) -> Column:
    """The value if it is above zero, else the default."""
    return F.when(value > 0, value).otherwise(default)


def badge_scale(count: Column, most: Column) -> Column:
    """Relative size of a shard's badge: by the root of its count against the largest; 1 if there is none."""
    return F.when(most > 0, F.lit(0.85) + F.lit(0.55) * F.sqrt(count) / F.sqrt(most)).otherwise(F.lit(1.0))


def link_width(base: float, calls_per_minute: Column) -> Column:
    return F.least(F.lit(base) + calls_per_minute / F.lit(10.0), F.lit(10.0))


def shortened(text: Column, most: int = 80) -> Column:
    """Longer texts end in three dots and have `most` characters."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def worker_of(key: Column, workers: int = 8) -> Column:
    """The worker that takes all tasks of a key, in order."""
    return fnv1a32(key) % workers


def load_scale(calls_per_minute: Column) -> Column:
    """Relative size of an object by its load: 1 at rest, 4 at most."""
    return F.least(F.lit(4.0), 1 + 3 * F.log10(1 + calls_per_minute) / F.log10(F.lit(601.0)))


def id_time_us(unique_id: Column) -> Column:
    """Microseconds encoded in the first 8 bytes of a URL-safe base64 id of 20 characters."""
    raw = F.unbase64(F.translate(unique_id, "-_", "+/"))
    return F.conv(F.hex(F.substring(raw, 1, 8)), 16, 10).cast("long")
