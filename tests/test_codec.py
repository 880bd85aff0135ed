import pytest
from hypothesis import given
from hypothesis import strategies as st

from ledgerframe.codec import abi, attributes, history, names, snapshot
from ledgerframe.codec.wire import Builder, Cursor, Malformed


@pytest.mark.parametrize(("raw", "n"), [("05", 5), ("d410", 2132), ("8001", 128)])
def test_varuint(raw, n):
    assert Cursor(bytes.fromhex(raw)).varuint(32) == n


@pytest.mark.parametrize("raw", ["", "80"])
def test_varuint_ends_early(raw):
    with pytest.raises(Malformed):
        Cursor(bytes.fromhex(raw)).varuint(32)


@given(st.integers(0, 2**63 - 1))
def test_varuint_round_trip(n):
    assert Cursor(Builder().varuint(n).bytes()).varuint() == n


def test_names():
    assert names.text_to_name("eosio") == 6138663577826885632
    for s in ("", "eosio", "1xq.o.c.wam", "zzzzzzzzzzzz"):
        assert names.name_to_text(names.text_to_name(s)) == s
    assert names.fnv1a64(b"eosio.token:WAX") == 13053440730298864435


@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
def test_names_keep_unsigned_order(a, b):
    assert (names.name_to_text(a) < names.name_to_text(b)) == (a < b) or names.name_to_text(a) == names.name_to_text(b)


def test_legacy_keys():
    pairs = {
        "PUB_K1_7epPHs9z9zrngVSXmUyuVLzCDE1SexW2tqTorJhugoQCAmyxZL": "EOS7epPHs9z9zrngVSXmUyuVLzCDE1SexW2tqTorJhugoQCErtqiU",
        "PUB_K1_7bQBpDGoX5qdYXWgwxF4LDKfGmDUFEmdYW9cZgvThHBj5L3Qz5": "EOS7bQBpDGoX5qdYXWgwxF4LDKfGmDUFEmdYW9cZgvThHBj4tENcy",
    }
    for new, old in pairs.items():
        assert names.k1_to_legacy(new) == old
    assert names.k1_to_legacy("PUB_R1_xyz") is None
    assert names.k1_to_legacy("PUB_K1_7epPHs9z9zrngVSXmUyuVLzCDE1SexW2tqTorJhugoQCAmyxZM") is None


def test_slots():
    assert names.slot_to_text(1229428973) == "2019-06-24T18:01:26.500"
    assert names.slot_to_text(1419922240) == "2022-07-01T03:25:20.000"
    assert names.slot_to_text(0) == "2000-01-01T00:00:00.000"


def test_assets():
    assert names.text_to_asset("11.30000000 WAX") == (1130000000, 8, "WAX")
    assert names.text_to_asset("0.5000 EOS") == (5000, 4, "EOS")
    assert names.text_to_asset("100 WAX") == (100, 0, "WAX")
    assert names.text_to_asset("garbage") is None
    assert names.asset_to_text(-12345, names.text_to_symbol(4, "EOS")) == "-1.2345 EOS"


def test_magic():
    assert history.is_ship(0xC35D500000000000) and history.is_ship(0xC35D500000000001) and not history.is_ship(0)


def test_payloads():
    for sized in (True, False):
        assert history.unpack_payload(history.pack_payload(b"abc" * 50, sized)) == b"abc" * 50
    assert history.unpack_payload(b"ab") == b""
    assert len(history.inflate_until(history.pack_payload(bytes(1 << 20)), lambda b: len(b) > 10, 64)) < 1 << 20


def test_account_rows():
    assert history.read_account_abi(bytes.fromhex("000000000000ea305580d61449020e65")) == ("eosio", bytes.fromhex("0e65"))
    assert history.read_account_abi(bytes.fromhex("000000000000ea305580d6144900")) is None
    row = history.pack_account_row("eosio", b"x")
    assert history.account_abis(history.pack_deltas({"account": [(1, row)]})) == [("eosio", b"x")]
    assert history.account_abis(history.pack_deltas({"code": [(1, row)], "account": [(1, row)]})) == []
    assert history.account_abis(b"\0") == []
    with pytest.raises(Malformed):
        history.account_abis(history.pack_deltas({"account": [(1, row)]})[:-3])


GOLDEN = bytes.fromhex(
    "041205064d756e69636806041200" "7b00210090030700" "0040bf09010a22"
    "1220b741a3b1cf5bfeae208c86efbfac8e0bbc0c92eea7ef9a2d9640"
    "12e6c2210f4c0bf6010c08feff03ffff0310181 0be3aa903f2c001".replace(" ", "")
)
FORMAT = [("id", "uint64"), ("name", "string"), ("test2", "fixed16[]"), ("test3", "float"), ("unused", "int32"), ("isTrueTrue", "bool"), ("image", "ipfs"), ("gibnumber", "int16"), ("onemore", "int16[]")]


def test_attributes():
    got = attributes.decode(GOLDEN, FORMAT)
    assert got == {
        "id": "18", "name": "Munich", "test2": [18, 123, 33, 912], "test3": -0.75, "isTrueTrue": 1,
        "image": "Qmag1NRBcpYyz27Kq2demHavXoi7nwbcCfkUq5vh6nuNN7", "gibnumber": 123, "onemore": [32767, -32768, 8, 12, 8, 3743, -213, 12345],
    }


def test_attribute_encodings():
    f = [("a", "x")] * 2 + [("i", "int16"), ("u", "uint16"), ("x", "x"), ("f", "fixed16")]
    assert attributes.decode(bytes.fromhex("06ac080796040 91602".replace(" ", "")), f) == {"i": 534, "u": 534, "f": 534}
    assert attributes.decode(bytes.fromhex("040000403f050000000000019040"), [("f", "float"), ("d", "double")]) == {"f": 0.75, "d": 1024.25}
    got = attributes.decode(bytes.fromhex("040905ffffffffffffffffff010601"), [("a", "int32"), ("b", "uint64"), ("c", "int64")])
    assert got == {"a": -5, "b": "18446744073709551615", "c": "-1"}
    for bad in ("04", "6300", "0100"):
        with pytest.raises(Malformed):
            attributes.decode(bytes.fromhex(bad), [("a", "uint64")])
        assert attributes.decode_or_empty(bytes.fromhex(bad), [("a", "uint64")]) == {}


def token_abi(field="quantity", type_="asset"):
    return abi.Abi(
        types={"account_name": "name"},
        structs={"transfer": ("", [("from", "account_name"), ("to", "name"), (field, type_), ("memo", "string")]), "account": ("", [("balance", "asset")]), "stat": ("", [("supply", "asset")])},
        actions={"transfer": "transfer"}, tables={"accounts": "account", "stat": "stat"},
    )


def test_interfaces():
    a = abi.Abi.parse(token_abi().pack())
    v = {"from": "alice", "to": "bob", "quantity": "1.0000 EOS", "memo": "hi"}
    assert a.decode("transfer", a.encode("transfer", v)) == v
    assert abi.parsed(b"\0") is None
    assert abi.is_token_contract(a)
    assert not abi.is_token_contract(token_abi("assetids", "uint64[]"))
    with pytest.raises(Malformed):
        a.decode("transfer", b"\1\2")


@given(st.integers(-(2**63), 2**63 - 1), st.booleans(), st.text(max_size=20), st.lists(st.integers(0, 255), max_size=5), st.one_of(st.none(), st.integers(0, 2**32 - 1)))
def test_values_round_trip(n, b, s, many, maybe):
    a = abi.Abi(structs={"base": ("", [("n", "int64")]), "t": ("base", [("b", "bool"), ("s", "string"), ("m", "uint8[]"), ("o", "uint32?"), ("v", "v")])}, variants={"v": ["int8", "string"]})
    v = {"n": str(n), "b": b, "s": s, "m": many, "o": maybe, "v": ["string", s]}
    assert a.decode("t", a.encode("t", v)) == v


@pytest.mark.parametrize("version", [6, 8])
def test_snapshots(version):
    w = snapshot.SnapshotWriter(version)
    w.contract({("eosio", "eosio", "voters"): [(1, "alice", b"v")], ("tok", "bob", "accounts"): [(2, "bob", b"a"), (3, "bob", b"b")]})
    w.accounts({"tok": token_abi().pack()})
    w.permissions([{"account": "", "perm_name": ""}, {"account": "bob", "perm_name": "active", "parent": "owner", "keys": [(b"\2" * 33, 1)]}], [{"account": "bob", "code": "tok", "action": "transfer", "perm_name": "active"}])
    data = w.bytes()
    assert snapshot.chain_version(data, snapshot.sections(data)) == version
    rows = list(snapshot.contract_rows(data))
    assert [r[:5] for r in rows] == [("eosio", "eosio", "voters", "1", "alice"), ("tok", "bob", "accounts", "2", "bob"), ("tok", "bob", "accounts", "3", "bob")]
    assert [r[3] for r in snapshot.contract_rows(data, lambda c, s, t: t == "accounts")] == ["2", "3"]
    assert [p["account"] for p in snapshot.permissions(data)] == ["bob"]
    assert list(snapshot.permission_links(data))[0]["action"] == "transfer"
    for bad in (b"\0" * 16, data[:8] + b"\1" + b"\0" * 30, data[:-40]):
        with pytest.raises(Malformed):
            list(snapshot.contract_rows(bad))
            snapshot.sections(bad[:20] + b"\xff" * 8)


def test_traces():
    act = {"ordinal": 1, "creator": 0, "receiver": "alice", "account": "tok", "name": "transfer", "data": b"xyz", "receipt": {"receiver": "alice", "act_digest": "AB" * 32, "global_sequence": "9"}, "ram_deltas": [{"account": "bob", "value": "-4"}], "return_value": b"\1"}
    data = history.pack_traces([{"id": "cd" * 32, "cpu_usage_us": 7, "actions": [act]}])
    [tx] = history.read_traces(data)
    assert tx["actions"][0]["data"] == b"xyz" and tx["actions"][0]["ram_deltas"] == [{"account": "bob", "value": "-4"}]
    assert history.read_traces(data[:-7]) is None
