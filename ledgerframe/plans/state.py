"""Snapshot rows to state collections: selectors, routing, document shapes and the joins between them.

Input rows are ``code, scope, table, primary_key, payer`` and ``json`` (the decoded row, null where it did not decode) with
``value`` (its bytes). Every collection is one DataFrame; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..codec import abi as abi_codec
from ..codec import attributes
from ..functions.columns import extended_symbols, parse_asset
from ..operators.asof import asof_join
from ..shipping import ship

#: Named groups of tables a user may ask for.
PRESETS = {
    "voters": ["eosio:eosio:voters"],
    "lightapi": ["eosio:eosio:voters", "accounts", "eosio:userres", "eosio:delband", "eosio:rexbal", "eosio:rexfund", "eosio:rexpool", "permissions"],
    "atomicassets": ["atomicassets:schemas", "atomicassets:collections", "atomicassets:templates", "atomicassets:assets", "atomicassets:offers", "atomicassets:config"],
    "atomicmarket": ["atomicmarket:sales", "atomicmarket:auctions", "atomicmarket:buyoffers", "atomicmarket:tbuyoffers", "atomicmarket:marketplaces", "atomicmarket:config"],
}
PRESETS["atomic"] = [*PRESETS["atomicassets"], *PRESETS["atomicmarket"]]


def parse_selectors(text: str) -> list[tuple[str, ...]]:
    """``table``, ``code:table``, ``code:scope:table``, presets, or ``*`` for all; a list separated by commas."""
    out: list[tuple[str, ...]] = []
    for item in text.split(","):
        item = item.strip()
        if item in ("*", "all"):
            return [()]
        if item in PRESETS:
            out += [tuple(p.split(":")) for p in PRESETS[item]]
            continue
        parts = tuple(item.split(":"))
        if not all(parts) or len(parts) > 3:
            raise ValueError(f"no table selector: {item!r}")
        out.append(parts)
    return out


def selected(selectors: list[tuple[str, ...]]) -> Column:
    """A filter that scans can use."""
    def one(t: tuple[str, ...]) -> Column:
        if not t:
            return F.lit(True)
        where = F.col("table") == t[-1]
        if len(t) > 1:
            where &= F.col("code") == t[0]
        return where & (F.col("scope") == t[1]) if len(t) == 3 else where

    return reduce(lambda a, b: a | b, [one(t) for t in selectors], F.lit(False))


def decode_rows(rows: DataFrame, versions: DataFrame, block: int) -> DataFrame:
    """Snapshot rows with ``json`` by the interface of their contract (at most one a contract in a snapshot)."""
    from .history import decode_payloads

    v = versions.select(F.col("account").alias("code"), F.col("abi"))
    return decode_payloads(rows.join(v, "code", "left").withColumn("prev_abi", F.lit(None).cast("binary")).withColumn("block_num", F.lit(block).cast("long")), "table", "table", "value")


def token_contracts(versions: DataFrame) -> DataFrame:
    """Accounts whose interface is that of a token."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            keep = [abi_codec.is_token_contract(abi_codec.parsed(x) if x else None) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep))], names=["code"])

    ship(versions.sparkSession)
    return versions.select("account", "abi").mapInArrow(run, "code string")


def j(path: str, source: str = "json") -> Column:
    return F.get_json_object(source, f"$.{path}")


def flag(path: str) -> Column:
    return F.coalesce(j(path).isin("1", "true"), F.lit(False))


def route() -> Column:
    """The collection of a row."""
    code, table = F.col("code"), F.col("table")
    return (
        F.when((code == "eosio") & (table == "voters"), "voters")
        .when(table == "accounts", "accounts")
        .when((code == "eosio.msig") & (table == "proposal"), "proposals")
        .when((code == "eosio.msig") & table.isin("approvals", "approvals2"), "approvals")
        .otherwise(F.concat(code, F.lit("-"), table))
    )


def voters(rows: DataFrame) -> DataFrame:
    r = rows.filter("code = 'eosio' and table = 'voters' and json is not null")
    return r.select(j("owner").alias("voter"), "primary_key", flag("is_proxy").alias("is_proxy"), j("last_vote_weight").alias("last_vote_weight"), j("proxied_vote_weight").alias("proxied_vote_weight"), j("staked").try_cast("long").alias("staked"), F.from_json(j("producers"), "array<string>").alias("producers"), j("proxy").alias("proxy"), "block_num")


def balances(rows: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Token balances with their exact text and a double; malformed balances are left out, and, where ``tokens`` is given,
    contracts that are no tokens."""
    r = rows.filter("table = 'accounts' and json is not null")
    if tokens is not None:
        r = r.join(tokens, "code", "left_semi")
    r = r.withColumn("a", parse_asset(j("balance"))).filter("a is not null")
    text = F.element_at(F.split(F.trim(j("balance")), " "), 1)
    return r.select("code", "scope", F.col("a.symbol").alias("symbol"), text.try_cast("double").alias("amount"), "block_num", F.col("a.precision").alias("decimals"), text.alias("amount_str"), text.try_cast("double").alias("amount_num"))


def proposals(rows: DataFrame) -> DataFrame:
    """Multi-signature proposals with their approvals; of repeated approvals of a proposal the last (by key) counts."""
    p = rows.filter("code = 'eosio.msig' and table = 'proposal' and json is not null").select(F.col("scope").alias("proposer"), j("proposal_name").alias("proposal_name"), j("packed_transaction").alias("packed_transaction"), "block_num")
    level = "array<struct<level:struct<actor:string,permission:string>,time:string>>"
    flat = lambda c: F.transform(F.from_json(j(c), level), lambda x: F.struct(x["level"]["actor"].alias("actor"), x["level"]["permission"].alias("permission"), x["time"].alias("time")))
    a = rows.filter("code = 'eosio.msig' and table = 'approvals2' and json is not null").select(F.col("scope").alias("proposer"), j("proposal_name").alias("proposal_name"), "primary_key", j("version").try_cast("int").alias("version"), flat("requested_approvals").alias("requested_approvals"), flat("provided_approvals").alias("provided_approvals"))
    a = a.groupBy("proposer", "proposal_name").agg(F.max_by(F.struct("version", "requested_approvals", "provided_approvals"), "primary_key").alias("x")).select("proposer", "proposal_name", "x.*")
    return p.join(a, ["proposer", "proposal_name"], "left")


def transactions_in(proposals_: DataFrame, versions: DataFrame) -> DataFrame:
    """Proposals with ``trx``: their packed transaction in JSON, the data of each action decoded where its contract's interface
    allows, else as it is in hex. The interface of every contract in the transaction is joined, not broadcast."""
    import json

    import pyarrow as pa

    header = abi_codec.Abi(structs={
        "permission_level": ("", [("actor", "name"), ("permission", "name")]),
        "action": ("", [("account", "name"), ("name", "name"), ("authorization", "permission_level[]"), ("data", "bytes")]),
        "extension": ("", [("type", "uint16"), ("data", "bytes")]),
        "transaction": ("", [("expiration", "time_point_sec"), ("ref_block_num", "uint16"), ("ref_block_prefix", "uint32"), ("max_net_usage_words", "varuint32"), ("max_cpu_usage_ms", "uint8"), ("delay_sec", "varuint32"), ("context_free_actions", "action[]"), ("actions", "action[]"), ("transaction_extensions", "extension[]")]),
    })

    def parse(text: str | None) -> dict | None:
        try:
            return header.decode("transaction", bytes.fromhex(text or ""), whole=False)
        except (ValueError, KeyError):
            return None

    def head(batches):
        for b in batches:
            found = [parse(t) for t in b.column(2).to_pylist()]
            accounts = [sorted({a["account"] for a in t["actions"]}) if t else [] for t in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([json.dumps(t) if t else None for t in found], pa.string()), pa.array(accounts, pa.list_(pa.string()))], names=["proposer", "proposal_name", "raw", "accounts"])

    ship(proposals_.sparkSession)
    heads = proposals_.select("proposer", "proposal_name", "packed_transaction").mapInArrow(head, "proposer string, proposal_name string, raw string, accounts array<string>")
    used = heads.select("proposer", "proposal_name", F.explode("accounts").alias("account")).join(versions.select("account", "abi"), "account").groupBy("proposer", "proposal_name").agg(F.collect_list(F.struct("account", "abi")).alias("abis"))

    def fill(batches):
        for b in batches:
            out = []
            for raw, abis in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                t = json.loads(raw) if raw else None
                by = {x["account"]: abi_codec.parsed(x["abi"]) for x in abis or []}
                for a in t["actions"] if t else []:
                    own = by.get(a["account"])
                    try:
                        if own:
                            a["data"] = own.decode(own.actions[a["name"]], bytes.fromhex(a["data"]))
                    except (ValueError, KeyError):
                        pass
                out.append(json.dumps(t) if t else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["proposer", "proposal_name", "trx"])

    done = heads.drop("accounts").join(used, ["proposer", "proposal_name"], "left").select("proposer", "proposal_name", "raw", "abis").mapInArrow(fill, "proposer string, proposal_name string, trx string")
    return proposals_.join(done, ["proposer", "proposal_name"], "left")


def resources(rows: DataFrame) -> DataFrame:
    """Staked resources of accounts, with their sum in base units."""
    r = rows.filter("code = 'eosio' and table = 'userres' and json is not null")
    units = lambda p: F.coalesce(parse_asset(j(p))["units"].cast("long"), F.lit(0))
    return r.select(F.col("scope").alias("account"), j("net_weight").alias("net_weight"), j("cpu_weight").alias("cpu_weight"), j("ram_bytes").try_cast("long").alias("ram_bytes"), (units("net_weight") + units("cpu_weight")).alias("stake"), "block_num")


def delegations(rows: DataFrame) -> DataFrame:
    r = rows.filter("code = 'eosio' and table = 'delband' and json is not null")
    return r.select(j("from").alias("from"), j("to").alias("to"), j("net_weight").alias("net_weight"), j("cpu_weight").alias("cpu_weight"), "block_num")


def dynamic(rows: DataFrame) -> DataFrame:
    """Any row as a document of its collection: position fields with ``@`` and the decoded row, else its bytes in hex."""
    meta = {"@scope": F.col("scope"), "@pk": F.col("primary_key"), "@payer": F.col("payer"), "@block_num": F.col("block_num")}
    return rows.select(route().alias("collection"), *[c.alias(n) for n, c in meta.items()], F.col("json").alias("doc"), F.when(F.col("json").isNull(), F.lower(F.hex("value"))).alias("value"))


_AUTH = "struct<threshold:int,keys:array<struct<key:string,weight:int>>,accounts:array<struct<permission:struct<actor:string,permission:string>,weight:int>>,waits:array<struct<wait_sec:bigint,weight:int>>>"


def permissions(raw: DataFrame, links: DataFrame) -> DataFrame:
    """Permissions with their authority and the actions linked to them, in the order of account and action."""
    linked = links.groupBy("account", "perm_name").agg(F.array_sort(F.collect_list(F.struct(F.col("code").alias("account"), "action"))).alias("linked_actions"))
    out = raw.withColumn("required_auth", F.from_json("required_auth", _AUTH)).join(linked, ["account", "perm_name"], "left")
    return out.withColumn("linked_actions", F.coalesce("linked_actions", F.array().cast("array<struct<account:string,action:string>>")))


def public_keys(permissions_: DataFrame) -> DataFrame:
    """(account, perm, key, key_pub): both written forms of each key; the older one only for K1 keys."""
    from ..functions.binary import legacy_key

    keys = permissions_.select("account", F.col("perm_name").alias("perm"), F.explode("required_auth.keys.key").alias("key_pub"))
    return keys.select("account", "perm", legacy_key("key_pub").alias("key"), "key_pub")


def schema_registry(rows: DataFrame) -> DataFrame:
    """(contract, collection_name, schema_name, format): the last of repeated schemas by key."""
    r = rows.filter("table = 'schemas' and json is not null").select(F.col("code").alias("contract"), F.col("scope").alias("collection_name"), j("schema_name").alias("schema_name"), F.from_json(j("format"), "array<struct<name:string,type:string>>").alias("format"), "primary_key", "block_num")
    return r.groupBy("contract", "collection_name", "schema_name").agg(F.max_by("format", "primary_key").alias("format"), F.max("block_num").alias("block_num"))


def decode_attributes(df: DataFrame, blobs: dict[str, str], format_: str = "format") -> DataFrame:
    """``df`` with a JSON column for each blob (bytes), typed by the format of its row; an unreadable blob is ``{}``."""
    import json

    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*[f for f in df.schema.fields if f.name not in blobs.values()], *[T.StructField(n, T.StringType()) for n in blobs.values()]])
    names = df.schema.names
    at, own = names.index(format_), [names.index(f.name) for f in schema.fields if f.name in names and f.name not in blobs.values()]
    sources = [names.index(b) for b in blobs]
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            formats = [[(x["name"], x["type"]) for x in f or []] for f in b.column(at).to_pylist()]
            made = [pa.array([json.dumps(attributes.decode_or_empty(x, f)) for x, f in zip(b.column(s).to_pylist(), formats, strict=True)], pa.string()) for s in sources]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in own], *made], schema=arrow)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def _bytes(path: str) -> Column:
    """uint8[] in JSON, as numbers or hex, as bytes."""
    numbers = F.from_json(j(path), "array<int>")
    digits = F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x), 2, "0")), "")
    return F.coalesce(F.unhex(digits), F.call_function("try_to_binary", j(path), F.lit("hex")))


def _json_map(c: str) -> Column:
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def nft_templates(rows: DataFrame, registry: DataFrame) -> DataFrame:
    r = rows.filter("table = 'templates' and json is not null").select(F.col("code").alias("contract"), F.col("scope").alias("collection_name"), j("template_id").try_cast("int").alias("template_id"), j("schema_name").alias("schema_name"), flag("transferable").alias("transferable"), flag("burnable").alias("burnable"), j("max_supply").try_cast("long").alias("max_supply"), j("issued_supply").try_cast("long").alias("issued_supply"), _bytes("immutable_serialized_data").alias("_i"), "block_num")
    joined = r.join(registry.drop("block_num"), ["contract", "collection_name", "schema_name"], "left")
    out = decode_attributes(joined, {"_i": "_ij"}).withColumn("immutable_data", _json_map("_ij"))
    return out.withColumn("data", F.col("immutable_data")).drop("_i", "_ij", "format")


def nft_assets(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Collectibles with both attribute maps and their union, in which the mutable one wins; template -1 is null."""
    r = rows.filter("table = 'assets' and json is not null").select(F.col("code").alias("contract"), j("asset_id").try_cast("decimal(20,0)").alias("asset_id"), F.col("scope").alias("owner"), j("collection_name").alias("collection_name"), j("schema_name").alias("schema_name"), F.nullif(j("template_id").try_cast("int"), F.lit(-1)).alias("template_id"), j("ram_payer").alias("ram_payer"), F.from_json(j("backed_tokens"), "array<string>").alias("_tokens"), _bytes("immutable_serialized_data").alias("_i"), _bytes("mutable_serialized_data").alias("_m"), "block_num")
    joined = r.join(registry.drop("block_num"), ["contract", "collection_name", "schema_name"], "left")
    out = decode_attributes(joined, {"_i": "_ij", "_m": "_mj"}).withColumns({"immutable_data": _json_map("_ij"), "mutable_data": _json_map("_mj")})
    from ..functions.columns import merge_maps

    token = lambda t: F.struct(parse_asset(t)["symbol"].alias("token_symbol"), parse_asset(t)["precision"].alias("token_precision"), parse_asset(t)["units"].cast("string").alias("amount"))
    out = out.withColumns({"data": merge_maps(F.col("immutable_data"), F.col("mutable_data")), "backed_tokens": F.coalesce(F.transform("_tokens", token), F.array())})
    return out.drop("_i", "_m", "_ij", "_mj", "_tokens", "format")


def nft_collections(rows: DataFrame, format_: list[tuple[str, str]]) -> DataFrame:
    """Collections; their attributes are typed by the one format of the contract's configuration."""
    r = rows.filter("table = 'collections' and json is not null").select(F.col("code").alias("contract"), j("collection_name").alias("collection_name"), j("author").alias("author"), flag("allow_notify").alias("allow_notify"), F.from_json(j("authorized_accounts"), "array<string>").alias("authorized_accounts"), F.from_json(j("notify_accounts"), "array<string>").alias("notify_accounts"), j("market_fee").try_cast("double").alias("market_fee"), _bytes("serialized_data").alias("_i"), "block_num")
    config = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in format_]) if format_ else F.array().cast("array<struct<name:string,type:string>>")
    return decode_attributes(r.withColumn("format", config), {"_i": "_ij"}).withColumn("data", _json_map("_ij")).drop("_i", "_ij", "format")


def nft_offers(rows: DataFrame) -> DataFrame:
    r = rows.filter("table = 'offers' and json is not null")
    ids = lambda p: F.from_json(j(p), "array<string>").alias(p)
    return r.select(F.col("code").alias("contract"), j("offer_id").alias("offer_id"), j("sender").alias("sender"), j("recipient").alias("recipient"), ids("sender_asset_ids"), ids("recipient_asset_ids"), j("memo").alias("memo"), j("ram_payer").alias("ram_payer"), "block_num")


_PAIRS = "array<struct<sym:string,contract:string>>"


def nft_config(rows: DataFrame) -> DataFrame:
    """The contract's configuration: version, format of collections and the tokens it knows."""
    r = rows.filter("table = 'config' and json is not null")
    format_ = F.from_json(j("collection_format"), "array<struct<name:string,type:string>>")
    return r.select(F.col("code").alias("contract"), j("version").alias("version"), format_.alias("collection_format"), extended_symbols(F.from_json(j("supported_tokens"), _PAIRS)).alias("supported_tokens"), "block_num")


def market_places(rows: DataFrame) -> DataFrame:
    r = rows.filter("table = 'marketplaces' and json is not null")
    return r.select(F.col("code").alias("contract"), j("marketplace_name").alias("marketplace_name"), j("creator").alias("creator"), "block_num")


def market_config(rows: DataFrame) -> DataFrame:
    """Fees, limits and tokens of the market."""
    r = rows.filter("table = 'config' and json is not null")
    tokens = F.from_json(j("supported_tokens"), "array<struct<token_contract:string,token_symbol:string>>")
    pairs = F.transform(tokens, lambda t: F.struct(t["token_symbol"].alias("sym"), t["token_contract"].alias("contract")))
    return r.select(F.col("code").alias("contract"), j("version").alias("version"), j("maker_market_fee").try_cast("double").alias("maker_market_fee"), j("taker_market_fee").try_cast("double").alias("taker_market_fee"), j("minimum_auction_duration").try_cast("long").alias("minimum_auction_duration"), j("maximum_auction_duration").try_cast("long").alias("maximum_auction_duration"), extended_symbols(pairs).alias("supported_tokens"), "block_num")


def market(rows: DataFrame, kind: str) -> DataFrame:
    """Sales, auctions, buy offers and template buy offers: price in base units, and a state for the first two (waiting until
    the assets or the offer are there)."""
    key, who, price = {"sales": ("sale_id", "seller", "listing_price"), "auctions": ("auction_id", "seller", "current_bid"), "buyoffers": ("buyoffer_id", "buyer", "price"), "tbuyoffers": ("buyoffer_id", "buyer", "price")}[kind]
    r = rows.filter((F.col("table") == kind) & F.col("json").isNotNull())
    listed = {"sales": F.coalesce(j("offer_id").try_cast("long"), F.lit(0)) > 0, "auctions": flag("assets_transferred")}.get(kind)
    what = j("template_id").try_cast("int").alias("template_id") if kind == "tbuyoffers" else F.from_json(j("asset_ids"), "array<string>").alias("asset_ids")
    a = parse_asset(j(price))
    return r.select(j(key).alias(key), j(who).alias(who), what, a["units"].cast("string").alias("price"), a["symbol"].alias("symbol"), a["precision"].alias("precision"), *([F.when(listed, 1).otherwise(0).alias("state")] if listed is not None else []), j("maker_marketplace").alias("marketplace"), j("collection_name").alias("collection_name"), j("collection_fee").try_cast("double").alias("collection_fee"), "block_num")


def state_at(deltas: DataFrame, keys: DataFrame, block: str = "block_num") -> DataFrame:
    """The row of each key in force at the key's block: code, scope, table, primary_key."""
    return asof_join(keys, deltas.withColumnRenamed(block, "_vf"), ["code", "scope", "table", "primary_key"], block, "_vf", ["position"], ["json", "value"])
