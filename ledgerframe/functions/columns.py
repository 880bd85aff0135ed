"""Scalar functions as columns: assets, times, numbers, names of indexes, JSON values. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ASSET = r"^(-?)(\d*)\.?(\d*) ([A-Z]{1,7})$"


def parse_asset(text: Column) -> Column:
    """``"1.0000 SYM"`` as struct(units decimal(38,0), precision int, symbol); null where malformed."""
    t = F.trim(text)
    part = lambda k: F.regexp_extract(t, _ASSET, k)
    whole, fraction = part(2), part(3)
    good = t.rlike(_ASSET) & (F.length(whole) + F.length(fraction) > 0)
    units = F.concat(part(1), whole, fraction).try_cast("decimal(38,0)")
    return F.when(good & units.isNotNull(), F.struct(units.alias("units"), F.length(fraction).alias("precision"), part(4).alias("symbol")))


def format_units(units: Column, precision: Column) -> Column:
    """Base units with a decimal point; the precision may differ by row."""
    digits = F.abs(units).cast("decimal(38,0)").cast("string")
    padded = F.when(F.length(digits) <= precision, F.lpad(digits, precision + 1, F.lit("0"))).otherwise(digits)
    cut = F.length(padded) - precision
    body = F.when(precision > 0, F.concat(padded.substr(F.lit(1), cut), F.lit("."), padded.substr(cut + 1, precision))).otherwise(padded)
    return F.concat(F.when(units < 0, "-").otherwise(""), body)


def format_asset(units: Column, precision: Column, symbol: Column) -> Column:
    return F.concat(format_units(units, precision), F.lit(" "), symbol)


def slot_timestamp(slot: Column) -> Column:
    """A block slot (half seconds since 2000-01-01) as a timestamp."""
    return F.timestamp_millis(F.lit(946684800000) + slot.cast("long") * 500)


def slot_iso(slot: Column) -> Column:
    return F.date_format(slot_timestamp(slot), "yyyy-MM-dd'T'HH:mm:ss.SSS")


def parse_utc(text: Column) -> Column:
    """ISO time with T or blank, optional fraction and Z, as a UTC timestamp; null where malformed."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(text), "Z$", ""), "T", " ")
    return F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?$"), F.try_to_timestamp(clean))


def expiration(text: Column) -> Column:
    """An ISO time with or without a zone as a timestamp; without one it is UTC. Only signs after the T are a zone's."""
    time = F.substring_index(text, "T", -1)
    zoned = text.endswith("Z") | (text.contains("T") & (time.contains("+") | time.contains("-")))
    return F.when(zoned, F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))).otherwise(F.try_to_timestamp(F.concat(text, F.lit("+00:00"))))


def age_seconds(now: Column, then: Column) -> Column:
    """Whole seconds from ``then`` to ``now``, never below 0."""
    return F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(then))


def index_partition(block: Column, size: int) -> Column:
    """Six-digit number of a block's partition: its ceiling, 1 at least."""
    return F.lpad(F.greatest(F.lit(1), F.ceil(block / size)).cast("string"), 6, "0")


def index_name(chain: str, kind: str, block: Column, size: int) -> Column:
    return F.concat(F.lit(f"{chain}-{kind}-"), index_partition(block, size))


def js_number(x: Column) -> Column:
    """Integral doubles below 2^53 print without a fraction."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 2.0**53), x.cast("long").cast("string")).otherwise(x.cast("string"))


def zigzag_decode(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-u.bitwiseAND(F.lit(1)))


def zigzag_encode(x: Column) -> Column:
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unsigned(x: Column) -> Column:
    """The bits of a long as an unsigned number."""
    return F.conv(F.hex(x), 16, 10).cast("decimal(20,0)")


def merge_maps(under: Column, over: Column) -> Column:
    """Both maps; the entries of ``over`` win. Does not depend on the session's duplicate policy."""
    rest = F.map_filter(under, lambda k, _: ~F.map_contains_key(over, k))
    return F.map_concat(rest, over)


def json_long(text: Column, *paths: str) -> Column:
    """The first of the paths that holds a number or a string of one."""
    return F.coalesce(*[F.get_json_object(text, p).try_cast("long") for p in paths])


def fixed_rate(units: Column, lendable: Column, total: Column) -> Column:
    """units x lendable / total, truncated toward zero in exact decimals; 0 without a pool."""
    exact = units.cast("decimal(38,0)") * lendable.cast("decimal(19,0)")
    # the remainder makes the division exact, so no rounding of the quotient can carry over
    over = total.cast("decimal(19,0)")
    return F.when(total > 0, ((exact - exact % over) / over).cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)"))


def snapshot_block(filename: Column) -> Column:
    """Block number of a snapshot file name: the first 8 of 64 hex digits, else trailing digits."""
    stem = F.regexp_replace(F.element_at(F.split(filename, "/"), -1), r"\.bin.*$|\.tar.*$|\.zst$|\.gz$", "")
    id_ = F.regexp_extract(stem, r"([0-9a-fA-F]{64})", 1)
    tail = F.regexp_extract(stem, r"(\d+)$", 1)
    return F.when(F.length(id_) == 64, F.conv(F.substring(id_, 1, 8), 16, 10).cast("long")).when(F.length(tail) > 0, tail.try_cast("long"))


def query_map(text: Column) -> Column:
    """``a=1&b=2`` as a map; a repeated key keeps its last value."""
    pairs = F.filter(F.split(text, "&"), lambda p: F.length(p) > 0)
    entry = lambda p: F.struct(F.element_at(F.split(p, "=", 2), 1).alias("k"), F.coalesce(F.try_element_at(F.split(p, "=", 2), F.lit(2)), F.lit("")).alias("v"))
    entries = F.transform(pairs, entry)
    indexed = F.transform(entries, lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), i.alias("i")))
    last = F.filter(indexed, lambda e: ~F.exists(indexed, lambda o: (o["k"] == e["k"]) & (o["i"] > e["i"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


def saturating_add(a: Column, b: Column) -> Column:
    """The sum of two longs, held at the ends of their range."""
    exact = a.cast("decimal(20,0)") + b.cast("decimal(20,0)")
    return F.least(F.greatest(exact, F.lit("-9223372036854775808").cast("decimal(20,0)")), F.lit("9223372036854775807").cast("decimal(20,0)")).cast("long")


def ceil_div(a: Column, b: Column) -> Column:
    """Whole division of longs, rounded up, for b > 0."""
    return ((a - F.pmod(a, b)) / b).cast("long") + F.when(F.pmod(a, b) == 0, 0).otherwise(1)


def canonical(x: Column, kind: T.DataType) -> Column:
    """The text by which a value is filtered: arrays as ``[a,b]``, text as it is, null as the empty text."""
    if isinstance(kind, T.ArrayType):
        inside = F.transform(x, lambda e: canonical(e, kind.elementType))
        return F.coalesce(F.concat(F.lit("["), F.concat_ws(",", inside), F.lit("]")), F.lit(""))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(js_number(x), F.lit(""))
    return F.coalesce(x.cast("string"), F.lit(""))


def backed_tokens(texts: Column) -> Column:
    """Asset texts as structs of symbol, precision and base units; malformed ones are left out."""
    parsed = F.filter(F.transform(texts, parse_asset), lambda a: a.isNotNull())
    return F.transform(parsed, lambda a: F.struct(a["symbol"].alias("token_symbol"), a["precision"].alias("token_precision"), a["units"].cast("string").alias("amount")))


def extended_symbols(items: Column) -> Column:
    """Structs of ``sym`` ("8,WAX") and ``contract`` as contract, symbol and precision; malformed symbols are left out."""
    good = F.filter(items, lambda x: x["sym"].rlike(r"^\d{1,2},[A-Z]{1,7}$"))
    return F.transform(good, lambda x: F.struct(F.coalesce(x["contract"], F.lit("")).alias("token_contract"), F.substring_index(x["sym"], ",", -1).alias("token_symbol"), F.substring_index(x["sym"], ",", 1).cast("int").alias("token_precision")))


def map_difference(ours: Column, theirs: Column) -> Column:
    """How two maps of JSON values differ: ``hard``, ``soft`` (only numbers that the other side has as text) or ``same``. A key
    that one side lacks is hard; values compare by their JSON text."""
    keys = F.array_union(F.map_keys(ours), F.map_keys(theirs))
    at = lambda m, k: F.try_element_at(m, k)
    number = lambda v: F.when(~v.startswith('"'), v.try_cast("double"))
    text = lambda v: F.when(v.startswith('"') & (F.length(F.trim(F.btrim(v, F.lit('"')))) > 0), F.btrim(v, F.lit('"')).try_cast("double"))

    def one(k: Column) -> Column:
        a, b = at(ours, k), at(theirs, k)
        variant = (number(a) == text(b)) | (number(b) == text(a))
        return F.when(a.eqNullSafe(b), 0).when(F.coalesce(variant, F.lit(False)), 1).otherwise(2)

    worst = F.coalesce(F.array_max(F.transform(keys, one)), F.lit(0))
    return F.when(worst == 2, "hard").when(worst == 1, "soft").otherwise("same")
