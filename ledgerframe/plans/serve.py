"""The serving templates: each endpoint as a function of collections and parameters that returns a DataFrame.

Wrong parameters raise ``ValueError`` (a bad request), an unknown chain ``LookupError`` (not found).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import age_seconds, format_units
from ..operators import lookups, ranking, rex
from ..operators.validation import clean


@dataclass
class Network:
    """Collections of a chain and its constants."""

    name: str
    chainid: str
    systoken: str = "EOS"
    decimals: int = 4
    rex_enabled: bool = False
    sync_threshold: int = 180
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise LookupError(f"{self.name} has no {name}")
        return self.tables[name]


def chain(networks: dict[str, Network], name: str) -> Network:
    if name not in networks:
        raise LookupError(f"unknown network {name}")
    return networks[name]


def rows_wanted(n: int) -> int:
    if not 10 <= n <= 1000:
        raise ValueError("the number of rows lies between 10 and 1000")
    return n


def code_hash(text: str) -> str:
    if not re.fullmatch(r"[0-9a-fA-F]{64}", text):
        raise ValueError("a code hash has 64 hexadecimal digits")
    return text.lower()


def public_key(text: str) -> str:
    if not re.fullmatch(r"(EOS[1-9A-HJ-NP-Za-km-z]{50}|PUB_(K1|R1|WA)_[1-9A-HJ-NP-Za-km-z]{40,})", text):
        raise ValueError("this is no public key")
    return text


def amount_text(default_decimals: int) -> tuple[Column, Column]:
    """(decimals, amount) as text: stored, else from the amount's digits, else the chain's default."""
    digits = F.when(F.instr("amount_str", ".") > 0, F.length(F.substring_index("amount_str", ".", -1)))
    decimals = F.coalesce(F.col("decimals"), digits, F.lit(default_decimals))
    return decimals.cast("string"), F.coalesce("amount_str", F.format_string(f"%.{default_decimals}f", "amount"), F.lit("0"))


def balances(net: Network, account: str) -> DataFrame:
    decimals, amount = amount_text(net.decimals)
    return net["accounts"].filter(F.col("scope") == account).select(F.col("code").alias("contract"), F.col("symbol").alias("currency"), decimals.alias("decimals"), amount.alias("amount")).orderBy("contract", "currency")


def token_balance(net: Network, account: str, contract: str, symbol: str) -> DataFrame:
    """One row: the amount, 0 without a balance."""
    _, amount = amount_text(net.decimals)
    found = net["accounts"].filter((F.col("scope") == account) & (F.col("code") == contract) & (F.col("symbol") == symbol)).select(amount.alias("amount"))
    return found.agg(F.coalesce(F.first("amount"), F.lit("0")).alias("amount"))


def account_info(net: Network, accounts: DataFrame) -> DataFrame:
    """For each ``account``: resources, permissions by name, delegations to and from it, and its code hash."""
    p = net["permissions"].groupBy("account").agg(F.array_sort(F.collect_list(F.struct("perm_name", "parent", "required_auth", "linked_actions"))).alias("list"))
    d = net["delegations"]
    given = d.groupBy(F.col("from").alias("account")).agg(F.array_sort(F.collect_list(F.struct("to", "cpu_weight", "net_weight"))).alias("list"))
    taken = d.groupBy(F.col("to").alias("account")).agg(F.array_sort(F.collect_list(F.struct("from", "cpu_weight", "net_weight"))).alias("list"))
    r = net["resources"].groupBy("account").agg(F.max_by(F.struct("cpu_weight", "net_weight", "ram_bytes"), "block_num").alias("x")).select("account", "x.*")
    parts = {"resources": r, "permissions": p, "delegated_to": given, "delegated_from": taken, "code": net["account_codehash"].select("account", "code_hash")}
    return lookups.assemble(accounts.select("account").distinct(), "account", parts)


def account(net: Network, name: str) -> DataFrame:
    """Account information and balances."""
    key = net["accounts"].sparkSession.createDataFrame([(name,)], "account string")
    held = balances(net, name).agg(F.collect_list(F.struct("contract", "currency", "decimals", "amount")).alias("balances"))
    return account_info(net, key).crossJoin(F.broadcast(held))


def all_accounts(net: Network) -> DataFrame:
    """Every account that appears in permissions, resources, delegations or code hashes."""
    return lookups.all_keys("account", net["permissions"], net["resources"], net["delegations"].select(F.col("from").alias("account")), net["delegations"].select(F.col("to").alias("account")), net["account_codehash"])


def top_holders(net: Network, contract: str, symbol: str, n: int) -> DataFrame:
    held = net["accounts"].filter((F.col("code") == contract) & (F.col("symbol") == symbol))
    return ranking.top(held.select(F.col("scope").alias("account"), F.col("amount_str").alias("amount"), F.col("amount_str").cast("decimal(38,8)").alias("_a")), rows_wanted(n), F.col("_a").desc(), F.col("account")).drop("_a")


def top_ram(net: Network, n: int) -> DataFrame:
    return ranking.top(net["resources"].filter("ram_bytes > 0").select("account", "ram_bytes"), rows_wanted(n), F.col("ram_bytes").desc(), F.col("account"))


def top_stake(net: Network, n: int) -> DataFrame:
    """By the stored sum of both stakes."""
    return ranking.top(net["resources"].filter("stake > 0").select("account", "stake", "cpu_weight", "net_weight"), rows_wanted(n), F.col("stake").desc(), F.col("account")).drop("stake")


def holder_count(net: Network, contract: str, symbol: str) -> DataFrame:
    return net["accounts"].filter((F.col("code") == contract) & (F.col("symbol") == symbol)).agg(F.count("*").alias("holders"))


def user_count(net: Network) -> DataFrame:
    return net["permissions"].agg(F.countDistinct("account").alias("users"))


def accounts_of_key(networks: dict[str, Network], key: str, cap: int = 100) -> DataFrame:
    """Accounts and permissions that a key opens on every chain, by either written form; the first ``cap`` hits in order."""
    public_key(key)
    out = None
    for net in networks.values():
        hits = net["pub_keys"].filter((F.col("key") == key) | (F.col("key_pub") == key)).orderBy("account", "perm").limit(cap)
        found = hits.select("account").distinct().join(net["permissions"], "account").select(F.lit(net.name).alias("network"), "account", "perm_name", "required_auth")
        out = found if out is None else out.unionByName(found)
    return out


def accounts_of_code(networks: dict[str, Network], hash_: str, cap: int = 1000) -> DataFrame:
    hash_ = code_hash(hash_)
    out = None
    for net in networks.values():
        found = net["account_codehash"].filter(F.col("code_hash") == hash_).orderBy("account").limit(cap).select(F.lit(net.name).alias("network"), "account")
        out = found if out is None else out.unionByName(found)
    return out


def rex_balance(net: Network, fund: DataFrame, buckets: DataFrame, now, lendable: int, total: int) -> DataFrame:
    """Fund, matured, maturing and savings of accounts as asset texts; buckets: account, units, matures."""
    if not net.rex_enabled:
        raise ValueError(f"{net.name} has no resource exchange")
    parts = rex.split(buckets, "account", "units", "matures", now, "2100-01-01", lendable, total)
    text = lambda c: F.concat(format_units(F.coalesce(c, F.lit(0).cast("decimal(38,0)")), F.lit(net.decimals)), F.lit(f" {net.systoken}"))
    return fund.join(parts, "account", "full_outer").select("account", F.col("fund"), *[text(F.col(c)).alias(c) for c in ("matured", "maturing", "savings")])


def rex_of(net: Network, account_: str, raw: bool = False) -> DataFrame:
    """The exchange holdings of an account from the collections ``rexfund`` (account, fund), ``rexbal`` (account, units, matures) and
    ``rexpool`` (lendable, total); ``raw`` gives the rows as they are, without internal columns."""
    if not net.rex_enabled:
        raise ValueError(f"{net.name} has no resource exchange")
    fund, held = (net[t].filter(F.col("account") == account_) for t in ("rexfund", "rexbal"))
    if raw:
        rows = held.groupBy("account").agg(F.array_sort(F.collect_list(F.struct(*[c for c in clean(held).columns if c != "account"]))).alias("rexbal"))
        return clean(fund).join(rows, "account", "full_outer")
    pool = net["rexpool"].select("lendable", "total").first()
    return rex_balance(net, fund.select("account", "fund"), held.select("account", "units", "matures"), F.current_timestamp(), pool.lendable if pool else 0, pool.total if pool else 0)


def sync(net: Network, blocks: DataFrame, now: Column) -> DataFrame:
    """Age of the newest block and whether it is within the chain's threshold; without a block time out of sync with delay 0."""
    newest = blocks.agg(F.max("block_num").alias("block_num"), F.max("block_time").alias("block_time"))
    delay = F.coalesce(age_seconds(now, F.col("block_time")), F.lit(0))
    ok = F.col("block_time").isNotNull() & (delay <= net.sync_threshold)
    return newest.select(F.lit(net.name).alias("network"), "block_num", "block_time", delay.cast("long").alias("delay"), F.when(ok, "OK").otherwise("OUT_OF_SYNC").alias("status"))


def status_text(rows: list) -> str:
    """``OK``, or the chains that are out of sync with their delay."""
    bad = [f"{r.network}:{r.delay}" for r in rows if r.status != "OK"]
    return "OK\r\n" if not bad else "OUT_OF_SYNC " + ";".join(bad) + "\r\n"


def freshest(candidates: list[DataFrame]) -> DataFrame:
    """The newest block of the first collection that has one."""
    newest = None
    for k, df in enumerate(candidates):
        one = df.agg(F.max("block_num").alias("block_num")).filter("block_num > 0").withColumn("rank", F.lit(k))
        newest = one if newest is None else newest.unionByName(one)
    return newest.agg(F.min_by("block_num", "rank").alias("block_num"))


def hydrate_actions(actions: DataFrame, requests: DataFrame, max_blocks: int = 4096) -> DataFrame:
    """Requested (pos, block_num, global_sequence) in their order; only the lowest ``max_blocks`` blocks are looked up."""
    allowed = requests.select("block_num").distinct().orderBy("block_num").limit(max_blocks)
    rows = actions.join(allowed, "block_num", "left_semi").dropDuplicates(["block_num", "global_sequence"])
    return lookups.hydrate(requests, rows, ["block_num", "global_sequence"])


def hydrate_deltas(deltas: DataFrame, requests: DataFrame, max_blocks: int = 4096) -> DataFrame:
    """As for actions, by block, code, scope, table and key; of repeated rows in a block the first counts."""
    key = ["block_num", "code", "scope", "table", "primary_key"]
    allowed = requests.select("block_num").distinct().orderBy("block_num").limit(max_blocks)
    found = deltas.join(allowed, "block_num", "left_semi")
    body = [c for c in deltas.columns if c not in (*key, "position")]
    rows = found.groupBy(*key).agg(F.min_by(F.struct(*body), "position").alias("_x")).select(*key, "_x.*")
    return lookups.hydrate(requests, rows, key)


def to_json(df: DataFrame, pretty: bool = False) -> str:
    """A bounded result as JSON with sorted keys; for large ones use :func:`stream`."""
    return json.dumps([json.loads(x) for x in df.toJSON().collect()], sort_keys=True, indent=2 if pretty else None)


def stream(df: DataFrame):
    """Rows one after another, a partition at a time at the driver, as for a socket that drains all holders."""
    return df.toLocalIterator(prefetchPartitions=True)


def action(actions: DataFrame, block: int, sequence: int) -> DataFrame:
    """One action by its block and global sequence; the block filter reaches the source."""
    return actions.filter((F.col("block_num") == block) & (F.col("global_sequence") == sequence))


def block(actions: DataFrame, number: int) -> DataFrame:
    """All actions of a block in their order."""
    return actions.filter(F.col("block_num") == number).orderBy("tx_pos", "first_position")


def health(blocks: DataFrame) -> DataFrame:
    """First and last block that can be served."""
    return blocks.agg(F.min("block_num").alias("first_block"), F.max("block_num").alias("last_block"), F.count("*").alias("blocks"))
