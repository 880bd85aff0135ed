import json

import pytest
from pyspark.sql import functions as F

from ledgerframe.codec import abi, snapshot
from ledgerframe.codec.names import key_to_text
from ledgerframe.operators import facets
from ledgerframe.plans import api, serve, state
from ledgerframe.sources import logs
from tests.test_codec import token_abi

NFT = abi.Abi(
    structs={
        "format": ("", [("name", "string"), ("type", "string")]), "schemas_s": ("", [("schema_name", "name"), ("format", "format[]")]),
        "templates_s": ("", [("template_id", "int32"), ("schema_name", "name"), ("transferable", "bool"), ("burnable", "bool"), ("max_supply", "uint32"), ("issued_supply", "uint32"), ("immutable_serialized_data", "uint8[]")]),
        "assets_s": ("", [("asset_id", "uint64"), ("collection_name", "name"), ("schema_name", "name"), ("template_id", "int32"), ("ram_payer", "name"), ("backed_tokens", "asset[]"), ("immutable_serialized_data", "uint8[]"), ("mutable_serialized_data", "uint8[]")]),
        "sales_s": ("", [("sale_id", "uint64"), ("seller", "name"), ("asset_ids", "uint64[]"), ("offer_id", "int64"), ("listing_price", "asset"), ("maker_marketplace", "name"), ("collection_name", "name"), ("collection_fee", "float64")]),
    },
    tables={"schemas": "schemas_s", "templates": "templates_s", "assets": "assets_s", "sales": "sales_s"},
)
SYS = abi.Abi(
    structs={"voter": ("", [("owner", "name"), ("is_proxy", "uint8"), ("staked", "int64"), ("producers", "name[]"), ("proxy", "name"), ("last_vote_weight", "float64"), ("proxied_vote_weight", "float64")]), "userres": ("", [("owner", "name"), ("net_weight", "asset"), ("cpu_weight", "asset"), ("ram_bytes", "int64")]), "delband": ("", [("from", "name"), ("to", "name"), ("net_weight", "asset"), ("cpu_weight", "asset")])},
    tables={"voters": "voter", "userres": "userres", "delband": "delband"},
)


@pytest.fixture(scope="module", params=[6, 8])
def rows(request, spark, tmp_path_factory):
    tok = token_abi()
    w = snapshot.SnapshotWriter(request.param)
    res = lambda who, n: SYS.encode("userres", {"owner": who, "net_weight": f"{n}.0000 EOS", "cpu_weight": "1.0000 EOS", "ram_bytes": str(100 * n)})
    asset = lambda k, t, mut: NFT.encode("assets_s", {"asset_id": str(k), "collection_name": "col", "schema_name": "sch", "template_id": t, "ram_payer": "bob", "backed_tokens": ["1.00 WAX"], "immutable_serialized_data": list(b"\4\3abc"), "mutable_serialized_data": mut})
    w.contract({
        ("eosio", "eosio", "voters"): [(1, "alice", SYS.encode("voter", {"owner": "alice", "is_proxy": 1, "staked": "5", "producers": ["p1", "p2"], "proxy": "", "last_vote_weight": "1.5", "proxied_vote_weight": "0"}))],
        ("eosio", "alice", "userres"): [(1, "alice", res("alice", 3))], ("eosio", "bob", "userres"): [(1, "bob", res("bob", 2))],
        ("eosio", "alice", "delband"): [(1, "alice", SYS.encode("delband", {"from": "alice", "to": "bob", "net_weight": "0.1000 EOS", "cpu_weight": "0.2000 EOS"}))],
        ("tok", "alice", "accounts"): [(5, "alice", tok.encode("account", {"balance": "12.3400 EOS"}))],
        ("tok", "bob", "accounts"): [(5, "bob", tok.encode("account", {"balance": "2.0000 EOS"})), (6, "bob", b"\1")],
        ("atomicassets", "col", "schemas"): [(1, "bob", NFT.encode("schemas_s", {"schema_name": "sch", "format": [{"name": "name", "type": "string"}, {"name": "rarity", "type": "string"}]}))],
        ("atomicassets", "col", "templates"): [(7, "bob", NFT.encode("templates_s", {"template_id": 7, "schema_name": "sch", "transferable": True, "burnable": False, "max_supply": 0, "issued_supply": 2, "immutable_serialized_data": list(b"\5\6Mythic")}))],
        ("atomicassets", "bob", "assets"): [(1000, "bob", asset(1000, 7, list(b"\4\3xyz"))), (1001, "bob", asset(1001, -1, [])), (1002, "bob", asset(1002, 7, [99]))],
        ("atomicmarket", "atomicmarket", "sales"): [(1, "bob", NFT.encode("sales_s", {"sale_id": "1", "seller": "bob", "asset_ids": ["1000"], "offer_id": "-1", "listing_price": "11.30000000 WAX", "maker_marketplace": "", "collection_name": "col", "collection_fee": "0.05"}))],
    })
    w.accounts({"tok": tok.pack(), "eosio": SYS.pack(), "atomicassets": NFT.pack(), "atomicmarket": NFT.pack()})
    w.permissions([{"account": "bob", "perm_name": "active", "parent": "owner", "keys": [(b"\2" * 33, 1)]}, {"account": "bob", "perm_name": "owner", "accounts": [("alice", "active", 1)]}], [{"account": "bob", "code": "tok", "action": "transfer", "perm_name": "active"}])
    path = f"{tmp_path_factory.mktemp('snap')}/s.bin"
    with open(path, "wb") as f:
        f.write(w.bytes())
    logs.register(spark)
    read = lambda kind, **o: spark.read.format(f"snapshot_{kind}").options(path=path, **o).load()
    versions = read("accounts")
    raw = read("rows")
    return read, versions, state.decode_rows(raw, versions, 100).cache()


def test_sections_and_selectors(rows):
    read, _, _ = rows
    assert read("sections").filter("name like '%account_object'").first().rows == 4
    assert read("rows", tables="accounts,eosio:voters").count() == 4
    assert read("rows").filter(state.selected(state.parse_selectors("tok:bob:accounts, voters"))).count() == 3
    assert state.parse_selectors("*") == [()]
    for bad in ("", "a:b:c:d", ":x"):
        with pytest.raises(ValueError):
            state.parse_selectors(bad)


def test_collections(rows):
    read, versions, r = rows
    v = state.voters(r).first()
    assert (v.voter, v.is_proxy, v.staked, v.producers) == ("alice", True, 5, ["p1", "p2"])
    tokens = state.token_contracts(versions)
    assert [t.code for t in tokens.collect()] == ["tok"]
    b = {x.scope: x for x in state.balances(r, tokens).collect()}
    assert b["alice"].amount_str == "12.3400" and b["alice"].amount == 12.34 and b["alice"].decimals == 4 and len(b) == 2
    assert {x.account: x.stake for x in state.resources(r).collect()} == {"alice": 40000, "bob": 30000}
    assert state.dynamic(r).filter("value is not null").count() == 1
    p = state.permissions(read("permissions"), read("links"))
    got = {x.perm_name: x for x in p.collect()}
    assert [tuple(x) for x in got["active"].linked_actions] == [("tok", "transfer")] and got["owner"].linked_actions == []
    k = state.public_keys(p).collect()
    assert [(x.account, x.key_pub) for x in k] == [("bob", key_to_text("K1", b"\2" * 33))] and k[0].key.startswith("EOS")


def test_collectibles(rows):
    _, _, r = rows
    registry = state.schema_registry(r)
    a = {int(x.asset_id): x for x in state.nft_assets(r, registry).collect()}
    assert a[1000].data == {"name": "xyz"} and a[1000].immutable_data == {"name": "abc"} and a[1001].template_id is None
    assert a[1002].mutable_data == {} and tuple(a[1000].backed_tokens[0]) == ("WAX", 2, "100")
    t = state.nft_templates(r, registry)
    assert t.first().data == {"rarity": "Mythic"}
    s = state.market(r, "sales").first()
    assert (s.price, s.symbol, s.precision, s.state) == ("1130000000", "WAX", 8, 0)
    assets = state.nft_assets(r, registry)
    dims = facets.dimensions(assets, ["name"])
    n = {(x.dim, x.key): x.n for x in facets.counts(dims).collect()}
    assert n["facet", "col/sch/name/abc"] == 3 and n["template", "7"] == 2 and n["owner", "bob"] == 3
    assert [int(x.asset_id) for x in facets.dim_page(dims, "template", "7", 10).collect()] == [1002, 1000]
    assert facets.intersect(dims, [("owner", "bob"), ("template", "7")]).count() == 2
    assert {int(x.asset_id): x.template_mint for x in facets.with_mint(assets).collect()} == {1000: 1, 1002: 2, 1001: 0}
    page = facets.hydrate(facets.dim_page(dims, "owner", "bob", 2), assets, t).collect()
    assert [int(x.asset_id) for x in page] == [1002, 1001] and page[0].template_data == {"rarity": "Mythic"}
    assert assets.select(facets.known_attributes(F.create_map(F.lit("name"), F.lit("x"), F.lit("zz"), F.lit("y")), F.array(F.struct(F.lit("name").alias("name")))).alias("m")).first().m == {"name": "x"}


def test_serving(rows, spark):
    read, versions, r = rows
    p = state.permissions(read("permissions"), read("links"))
    net = serve.Network("eos", "ab" * 32, tables={
        "accounts": state.balances(r), "resources": state.resources(r), "delegations": state.delegations(r), "permissions": p, "pub_keys": state.public_keys(p),
        "account_codehash": spark.createDataFrame([("tok", "cd" * 32, 100)], "account string, code_hash string, block_num long"),
    })
    nets = {"eos": net}
    assert [tuple(x) for x in serve.balances(net, "alice").collect()] == [("tok", "EOS", "4", "12.3400")]
    assert serve.token_balance(net, "nobody", "tok", "EOS").first().amount == "0"
    assert [x.account for x in serve.top_holders(net, "tok", "EOS", 10).collect()] == ["alice", "bob"]
    assert [x.account for x in serve.top_ram(net, 10).collect()] == ["alice", "bob"] and serve.top_stake(net, 10).first().account == "alice"
    assert serve.holder_count(net, "tok", "EOS").first()[0] == 2 and serve.user_count(net).first()[0] == 1
    bob = serve.account(net, "bob").first()
    assert [x.perm_name for x in bob.permissions.list] == ["active", "owner"] and bob.delegated_from.list[0]["from"] == "alice" and bob.code is None and bob.balances[0].amount == "2.0000"
    assert sorted(x.account for x in serve.all_accounts(net).collect()) == ["alice", "bob", "tok"]
    key = state.public_keys(p).first()
    for k in (key.key, key.key_pub):
        assert sorted(x.perm_name for x in serve.accounts_of_key(nets, k).collect()) == ["active", "owner"]
    assert serve.accounts_of_code(nets, "CD" * 32).first().account == "tok"
    for bad in (lambda: serve.top_ram(net, 9), lambda: serve.accounts_of_code(nets, "xy"), lambda: serve.public_key("EOSx")):
        with pytest.raises(ValueError):
            bad()
    assert api.answer(nets, "/api/tokenbalance/eos/alice/tok/EOS") == (200, "text/plain", "12.3400\r\n")
    assert api.answer(nets, "/api/balances/none/alice")[0] == 404 and api.answer(nets, "/api/topram/eos/5")[0] == 400
    assert json.loads(api.answer(nets, "/api/topholders/eos/tok/EOS/10")[2])[0]["account"] == "alice"
    blocks = spark.createDataFrame([(5, "2024-01-01 00:00:00")], "block_num long, t string").select("block_num", F.col("t").cast("timestamp").alias("block_time"))
    s = serve.sync(net, blocks, F.lit("2024-01-01 00:10:00").cast("timestamp")).collect()
    assert s[0].delay == 600 and serve.status_text(s) == "OUT_OF_SYNC eos:600\r\n"


def test_exchange(spark):
    from ledgerframe.operators import rex

    b = spark.createDataFrame([("a", 10000, 0), ("a", 5000, 500), ("a", 7000, 2000), ("a", 9000, 4102444800)], "account string, units long, due long")
    one = rex.split(b, "account", "units", "due", 1000, 4102444800, 1, 1).first()
    assert tuple(map(int, one[1:])) == (15000, 7000, 9000)
    two = rex.split(b, "account", "units", "due", 1000, 4102444800, 2, 1).first()
    assert int(two.matured) == 30000
    assert int(rex.split(b, "account", "units", "due", 1000, 4102444800, 2, 0).first().matured) == 0
