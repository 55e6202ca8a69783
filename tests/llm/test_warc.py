import hashlib
import io
import random

import pytest

from cloudtally.llm import warc
from cloudtally.runtime import new_folder


def members(n, zipped=True, seed=1):
    rng = random.Random(seed)
    made = []
    for k in range(n):
        payload = rng.randbytes(rng.choice([0, 10, 3000, 90_000])) + b"\r\n\r\nWARC/1.0\r\n" * (k % 2)
        rec = warc.record({"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{k}>", "WARC-Block-Digest": f"sha1:{warc.digest(payload)}"}, payload)
        made.append((payload, warc.squeeze(rec) if zipped else rec))
    return made


@pytest.mark.parametrize("zipped", [True, False])
def test_undamaged_files_give_every_record(zipped):
    made = members(12, zipped)
    found = list(warc.salvage(io.BytesIO(b"".join(m for _, m in made))))
    assert [f[0] for f in found] == ["record"] * 12
    assert [f[4] for f in found] == [p for p, _ in made]
    assert sum(f[2] for f in found) == sum(len(m) for _, m in made)


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("seed", range(12))
def test_damage_costs_only_what_it_touches(zipped, seed):
    rng = random.Random(seed)
    made = members(14, zipped, seed)
    hurt = sorted(rng.sample(range(14), 3))
    parts = []
    for k, (_, m) in enumerate(made):
        if k in hurt:
            how = rng.choice(["cut", "flip", "gone"])
            at = rng.randrange(1, len(m) - 1)
            m = m[:at] if how == "cut" else b"" if how == "gone" else m[:at] + bytes([m[at] ^ 0x55]) + m[at + 1 :]
        parts.append(m)
    data = rng.randbytes(50) + b"".join(parts)
    found = list(warc.salvage(io.BytesIO(data)))
    got = {f[3].get("warc-record-id") for f in found if f[0] == "record"}
    assert got >= {f"<urn:page:{k}>" for k in range(14) if k not in hurt}
    spans = sorted((f[1], f[2]) for f in found)
    at = 0
    for place, length in spans:
        assert place == at
        at += length
    assert at == len(data)


def test_empty_file_and_noise():
    assert list(warc.salvage(io.BytesIO(b""))) == []
    noise = random.Random(0).randbytes(300_000)
    assert [f[:3] for f in warc.salvage(io.BytesIO(noise))] == [("gap", 0, 300_000)]


def test_round_trip_with_revisits(spark):
    texts = ["a", "b" * 70_000, None, "", "a", "a", "é", "b" * 70_000]
    rows = [(k, f"http://h/{k}\n" if k else None, t, "extra") for k, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "id long, url string, t string, sha string").repartition(3)
    pages = pages.selectExpr("id", "url", "cast(t as binary) as payload", "sha")
    for min_bytes, file_bytes in ((0, 1 << 20), (2, 1)):
        found = warc.round_trip(pages, min_bytes, file_bytes).collect()
        assert {r.kind for r in found} == {"record"} and len(found) == len(texts)
        for r in found:
            k = int(r.fields["warc-record-id"][10:-1])
            payload = (texts[k] or "").encode()
            top = max(j for j, t in enumerate(texts) if (t or "").encode() == payload)
            again = len(payload) >= min_bytes and k != top
            assert r.fields["warc-type"] == ("revisit" if again else "response")
            assert r.fields.get("warc-refers-to") == (f"<urn:page:{top}>" if again else None)
            assert bytes(r.payload) == (b"" if again else payload)
            assert r.fields["warc-payload-digest"] == f"sha1:{warc.digest(payload)}"
            assert int(r.fields["warc-payload-length"]) == len(payload)
    assert hashlib.sha1(b"").hexdigest() and warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_long_records_by_reader_and_writer():
    payload = random.Random(1).randbytes(5000)
    rec = warc.record({"WARC-Type": "response", "WARC-Block-Digest": f"sha1:{warc.digest(payload)}"}, payload)
    for data in (rec, warc.squeeze(rec)):
        assert [f[4] for f in warc.salvage(io.BytesIO(data * 2))] == [payload] * 2
        assert {f[0] for f in warc.salvage(io.BytesIO(data * 2), longest=1000)} == {"gap"}


@pytest.mark.parametrize("zipped", [True, False])
def test_time_grows_with_the_bytes(zipped):
    import time

    def seconds(mb):
        long = warc.record({"WARC-Type": "response"}, random.Random(mb).randbytes(1 << 20) * mb)
        data = (warc.squeeze(long) if zipped else long) + b"".join(m for _, m in members(200, zipped))
        start = time.process_time()
        assert [f[0] for f in warc.salvage(io.BytesIO(data))] == ["record"] * 201
        return time.process_time() - start

    seconds(1)
    assert seconds(64) < 30 * max(seconds(8), 0.05)


def test_rows_in_and_rows_out_with_null_ids(spark):
    pages = spark.createDataFrame([(None, None, b"x"), (None, "u", b"x"), (3, "u", b"x"), (None, "u", b"y" * 300_000), (3, "u", None)], "id long, url string, payload binary")
    found = warc.round_trip(pages).collect()
    assert [r.kind for r in found] == ["record"] * 5
    assert sorted(r.fields["warc-type"] for r in found) == ["response"] * 3 + ["revisit"] * 2


def test_empty_table(spark):
    pages = spark.createDataFrame([], "id long, url string, payload binary")
    assert warc.read(warc.archive(pages, new_folder(spark))).count() == 0
