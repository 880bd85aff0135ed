"""Envelopes, slices, packed snapshots, unfinished files, sorted outputs, made-up events, configurations and routes."""

import gzip
import io
import json
import struct
import tarfile

import pytest
import zstandard
from pyspark.sql import functions as F

from ledgerframe.codec import history, snapshot
from ledgerframe.operators import validation
from ledgerframe.plans import api, serve, state
from ledgerframe.sources import logs, sinks
from ledgerframe.streaming import generator


def envelope(block=None, before=False, parts=(None, None, None), variant=1):
    out = bytes([variant]) + b"\0" * 72
    out += b"\1" + struct.pack("<I", block) + b"\0" * 32 if block is not None else b"\0"
    out += b"\1" + b"\0" * 36 if before else b"\0"
    for p in parts:
        out += b"\0" if p is None else b"\1" + bytes([len(p)]) + p
    return out


def test_result_messages():
    assert history.read_result(envelope(7, True, (b"bb", None, b"ddd"))) == (7, b"ddd")
    assert history.read_result(envelope(7)) == (7, b"") and history.read_result(envelope()) is None
    assert history.read_result(envelope(7, variant=0)) is None and history.read_result(b"") is None
    whole = envelope(7, True, (b"bb", b"t", b"ddd"))
    assert all(history.read_result(whole[:k]) is None for k in range(len(whole)))


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "state")
    w = history.LogWriter(path)
    for b in range(5, 305):
        w.add(b, history.pack_payload(f"payload {b}".encode()))
    w.close()
    logs.register(spark)
    return path


def test_slices(spark, log, tmp_path):
    assert history.slice_log(log, str(tmp_path / "cut"), 100, 120) == 21
    cut = spark.read.format("ship_log").option("path", str(tmp_path / "cut")).load()
    want = spark.read.format("ship_log").option("path", log).load().filter("block_num between 100 and 120")
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, want.collect()))
    assert history.slice_log(log, str(tmp_path / "end"), 300, 900) == 5


def test_sparse_reads_take_only_their_entries_of_the_index(log):
    class Counted(io.FileIO):
        taken = 0

        def read(self, n=-1):
            Counted.taken += n
            return super().read(n)

    blocks = (5, 6, 7, 100, 300, 304)
    with Counted(f"{log}.index") as index, open(f"{log}.index", "rb") as plain:
        raw = plain.read()
        assert list(logs._offsets(index, 5, blocks)) == [(b, struct.unpack_from("<Q", raw, (b - 5) * 8)[0]) for b in blocks]
        assert Counted.taken == 8 * len(blocks)
        assert [b for b, _ in logs._offsets(index, 5, range(5, 305))] == list(range(5, 305))


def test_snapshots_by_section_and_packed(spark, tmp_path):
    w = snapshot.SnapshotWriter(8)
    w.contract({("tok", "bob", "accounts"): [(2, "bob", b"a"), (3, "bob", b"b" * 2000)]})
    w.accounts({"tok": b"abi"})
    data = w.bytes()
    logs.register(spark)
    plain = tmp_path / "s.bin"
    plain.write_bytes(data)
    assert snapshot.sections_of(io.BytesIO(data), len(data)) == snapshot.sections(data)
    for bad in (b"", b"\0" * 16, data[:-40]):
        with pytest.raises(snapshot.Malformed):
            snapshot.sections_of(io.BytesIO(bad), len(bad))
    small = snapshot.only(io.BytesIO(data), snapshot.sections(data), ("account_object",))
    assert list(snapshot.accounts(small)) == [("tok", b"abi")] and len(small) < 200
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        for name, body in (("readme", b"x"), ("snap.bin", data)):
            member = tarfile.TarInfo(name)
            member.size = len(body)
            t.addfile(member, io.BytesIO(body))
    (tmp_path / "s.tar.gz").write_bytes(gzip.compress(tar.getvalue()))
    (tmp_path / "s.tar.zst").write_bytes(zstandard.compress(tar.getvalue()))
    (tmp_path / "z.bin.zst").write_bytes(zstandard.compress(data))
    read = lambda kind, path: sorted(map(tuple, spark.read.format(f"snapshot_{kind}").option("path", str(path)).load().collect()))
    for kind in ("rows", "accounts", "sections"):
        want = read(kind, plain)
        assert want and all(read(kind, tmp_path / n) == want for n in ("s.tar.gz", "s.tar.zst", "z.bin.zst")), kind
    sibling = logs.unpacked(str(tmp_path / "z.bin.zst"))
    assert open(sibling, "rb").read() == data and logs.unpacked(str(plain)) == str(plain)  # noqa: SIM115
    assert not list(tmp_path.glob("*.part"))


def test_unfinished_lines(tmp_path):
    p = tmp_path / "x.ndjson"
    for body, kept in ((b"", 0), (b"a\nb\n", 4), (b"a\nbroken", 2), (b"broken", 0), (b"a\n" + b"x" * 200_000, 2)):
        p.write_bytes(body)
        assert sinks.complete_lines(str(p)) == kept and p.read_bytes() == body[:kept]


def test_documents_in_the_order_of_their_index(spark, tmp_path):
    d = spark.range(200).select((F.col("id") * 37 % 200).alias("block_num"), (F.col("id") % 3).cast("string").alias("scope"), F.col("id").cast("string").alias("primary_key"), F.col("id").alias("global_sequence"))
    for kind, key in (("action", lambda r: -r.global_sequence), ("delta", lambda r: (-r.block_num, r.scope, r.primary_key))):
        sinks.write_in_order(d, str(tmp_path / kind), kind, 4)
        got = [r for f in sorted((tmp_path / kind).glob("part-*")) for r in spark.read.parquet(str(f)).coalesce(1).collect()]
        assert got == sorted(got, key=key) and len(got) == 200


def test_made_up_events(spark):
    e = generator.made_events(spark, 20_000, assets=5000, parts=3)
    share = {r.op: r["count"] / 20_000 for r in e.groupBy("op").count().collect()}
    assert all(abs(share[op] - n / 100) < 0.02 for op, n in generator.SHARES)
    again = generator.made_events(spark, 20_000, assets=5000, parts=7)
    assert e.exceptAll(again).isEmpty() and e.filter("op = 'mint' and asset_id < 5000").isEmpty()
    low = e.filter("op <> 'mint' and asset_id < 500").count() / e.filter("op <> 'mint'").count()
    assert low > 0.25 and e.filter("op <> 'mint' and asset_id >= 5000").isEmpty()


def test_configurations(spark):
    rows = spark.createDataFrame(
        [
            ("atomicassets", "s", "config", json.dumps({"version": "1.2", "collection_format": [{"name": "name", "type": "string"}], "supported_tokens": [{"sym": "8,WAX", "contract": "eosio.token"}, {"sym": "bad"}]}), 9),
            ("market", "s", "marketplaces", json.dumps({"marketplace_name": "m", "creator": "bob"}), 9),
            ("market", "s", "config", json.dumps({"version": "2", "maker_market_fee": "0.01", "taker_market_fee": 0.02, "minimum_auction_duration": 120, "maximum_auction_duration": "2592000", "supported_tokens": [{"token_contract": "eosio.token", "token_symbol": "8,WAX"}]}), 9),
        ],
        "code string, scope string, table string, json string, block_num long",
    )
    c = state.nft_config(rows.filter("code = 'atomicassets'")).first()
    assert c.version == "1.2" and [tuple(t) for t in c.supported_tokens] == [("eosio.token", "WAX", 8)] and c.collection_format[0].name == "name"
    assert tuple(state.market_places(rows).first()) == ("market", "m", "bob", 9)
    m = state.market_config(rows.filter("code = 'market'")).first()
    assert (m.maker_market_fee, m.taker_market_fee, m.minimum_auction_duration, m.maximum_auction_duration) == (0.01, 0.02, 120, 2592000)
    assert m.supported_tokens[0].token_symbol == "WAX"


def test_clean_documents(spark):
    d = spark.createDataFrame([(1, 2, 3)], ["_id", "@timestamp", "a"])
    assert validation.clean(d).columns == ["a"]


def test_routes(spark):
    fund = spark.createDataFrame([("bob", "5.0000 EOS", 1)], "account string, fund string, _id int")
    held = spark.createDataFrame([("bob", 20000, "2020-01-01"), ("bob", 10000, "2150-01-01")], "account string, units long, matures string").withColumn("matures", F.col("matures").cast("timestamp"))
    blocks = spark.createDataFrame([(5, "2024-01-01 00:00:00")], "block_num long, t string").select("block_num", F.col("t").cast("timestamp").alias("block_time"))
    acts = spark.createDataFrame([(5, 1, 1, 77), (5, 0, 1, 76)], "block_num long, tx_pos int, first_position int, global_sequence long")
    net = serve.Network("eos", "ab" * 32, rex_enabled=True, tables={"blocks": blocks, "rexfund": fund, "rexbal": held, "rexpool": spark.createDataFrame([(2, 1)], "lendable long, total long"), "actions": acts})
    nets = {"eos": net}
    get = lambda path: api.answer(nets, path)
    assert get("/api/sync/eos")[2].endswith("OUT_OF_SYNC\r\n") and get("/api/status")[2].startswith("OUT_OF_SYNC eos:")
    [rex] = json.loads(get("/api/rexbalance/eos/bob")[2])
    assert (rex["fund"], rex["matured"], rex["savings"]) == ("5.0000 EOS", "4.0000 EOS", "2.0000 EOS")
    [raw] = json.loads(get("/api/rexraw/eos/bob")[2])
    assert "_id" not in raw and len(raw["rexbal"]) == 2
    assert json.loads(get("/api/action/eos/5/77")[2])[0]["tx_pos"] == 1
    assert [r["global_sequence"] for r in json.loads(get("/api/block/eos/5")[2])] == [76, 77]
    assert json.loads(get("/api/health/eos")[2])[0]["last_block"] == 5
    assert get("/api/sync/none")[0] == 404 and get("/api/nothing")[0] == 404 and get("/api/accinfo/eos/bob")[0] == 404
    net.rex_enabled = False
    assert get("/api/rexbalance/eos/bob")[0] == 400
