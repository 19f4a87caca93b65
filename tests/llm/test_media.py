import hashlib
import io
import random
import struct
import time
import wave
import zipfile
import zlib

from pyspark.sql import functions as F

from lexquarry.llm import media as M


def png(body=b"x"):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" + body)) + chunk(b"IEND", b"")


def files():
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.txt", "text")
    bmp = b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + b"\0" * 24 + b"\1\2\3\0"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x03\x01\x12\xff\x00\x34\xff\xd9"
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
    box = lambda k, d: struct.pack(">I", 8 + len(d)) + k + d
    return {
        "image/png": png(),
        "application/zip": held.getvalue(),
        "image/bmp": bmp,
        "image/jpeg": jpeg,
        "image/gif": gif,
        "audio/wav": M.wav(b"odd"),
        "application/pdf": b"%PDF-1.4\nstartxref\n0\n%%EOF",
        "video/mp4": box(b"ftyp", b"isom") + box(b"moov", b"abc"),
        "audio/flac": b"fLaC\x80\x00\x00\x22" + b"\0" * 34 + b"\xff\xf8rest",
    }


def test_formats_are_confirmed_carved_and_rejected_when_broken():
    for kind, data in files().items():
        assert M.sniff(data) == [(kind, 0, len(data))], kind
        if kind != "audio/flac":  # its frames go on to the end
            assert (kind, 7, len(data)) in M.sniff(b"before." + data + b"after"), kind
            assert all(k != kind for k, _, _ in M.sniff(data[:-1])), kind
    broken = bytearray(png())
    broken[30] ^= 1
    assert M.sniff(bytes(broken)) == []
    assert M.sniff(b"BM RIFF GIF89a %PDF- PK\x03\x04 ftyp") == []


def test_time_is_linear():
    for unit in (b"%PDF-1.4 ", b"%PDF-", b"PK\x03\x04", b"\xff\xd8\xff\xda\x00\x02", b"BM", b"GIF89a", b"\x89PNG\r\n\x1a\n", b"fLaC", b"RIFF", b"ftyp"):
        for end in (b"", b"%%EOFPK\x05\x06" + b"\0" * 18):
            data = unit * ((5_000_000 if unit[:1] in b"%P" else 1_000_000) // len(unit)) + end
            began = time.process_time()
            M.sniff(data)
            assert time.process_time() - began < 5, unit  # quadratic: minutes


def test_time_is_linear_where_walks_go_far():
    n = 600_000
    chains = {
        "mp4 boxes": b"\0\0\0\x08ftyp" * (n // 8),
        "GIF sub-blocks": b"GIF89a\x01\0\x01\0\0\0\0!\xf9\x04abcd" * (n // 20),
        "GIF images": b"GIF89a\x01\0\x01\0\0\0\0,\0\0\0\0\1\0\1\0\0\2\1x" * (n // 26),
        "nested RIFF": b"".join(b"RIFF" + struct.pack("<I", n - 12 * i - 8) + b"WAVE" for i in range(n // 12)),
        "RIFF chunks": b"".join(b"RIFF" + struct.pack("<I", n - 12 * i - 8) + b"WAVE" for i in range(n // 24)) + b"junk\0\0\0\0" * (n // 16),
        "FLAC blocks": (b"fLaC\0\0\0\x22" + b"x" * 34 + b"\1\0\0\0") * (n // 46),
        "PNG chunks": (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"0" * 13) + chunk(b"tEXt", b"")) * (n // 45),
    }
    for name, data in chains.items():
        began = time.process_time()
        M.sniff(data)
        assert time.process_time() - began < 5, name


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def brute_feature(data):
    """Of a wave file of 8-bit samples, by the standard library, and by trying every place for every format."""
    with wave.open(io.BytesIO(data)) as w:
        samples, head = w.readframes(w.getnframes()), f"audio/wav;rate={w.getframerate()};bits={8 * w.getsampwidth()};frames={w.getnframes()}"
    inside, free = [], 1
    for at in range(1, len(data)):
        for magic, offset, kind in M.SIGNATURES:
            start = at - offset
            if start >= free and data[at : at + len(magic)] == magic and (n := M.VALIDATORS[kind](data, start, M.Marks(data))):
                inside.append(f"{kind}@{start}+{n}")
                free = start + n
    return f"{head};peak={max(samples, default=0)};sum={sum(samples)};embedded={','.join(inside) or 'none'}"


def test_feature():
    rng = random.Random(3)
    parts = [d for k, d in files().items() if k not in ("audio/flac", "video/mp4")] + [b"PK\x03\x04", b"%PDF-1", b"%%EOF", b"\xff\xd8\xff", b"words", b"GIF89a"]
    for _ in range(60):
        body = M.padded(b" ".join(rng.choice(parts) for _ in range(rng.randint(0, 5))))
        kind, payload, _, feature = M.features(M.wav(body))
        assert (kind, payload, feature) == ("audio/wav", body, brute_feature(M.wav(body)))


def test_wav_is_read_by_the_standard_library():
    for data in (b"", b"a", b"\x00\xff" * 50):
        with wave.open(io.BytesIO(M.wav(data))) as w:
            assert (w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())) == (1, 1, data)


def test_round_trip(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "é" * 32, "x" * 64, "x" * 65, "RIFF BM %PDF-1.4 startxref %%EOF", "🎉\0" * 5000, "".join(rng.choices("abé\n", k=1000)), "a"]
    docs = spark.createDataFrame([(i, t, "clash", "m") for i, t in enumerate(texts)], "doc_id long, text string, payload string, feature string")
    out = M.inspect(docs.withColumn("media", M.store(F.col("text")))).orderBy("doc_id").collect()
    assert out[0].asDict().keys() == {*docs.columns, "media", "sniffed"}
    for r, text in zip(out, texts, strict=True):
        data = (text or "").encode()
        want = data + b"\0" * (64 - len(data) if not data else -len(data) % 64)
        assert bytes(r["sniffed"]["payload"]) == want and r["sniffed"]["detected"] == "audio/wav" and r["sniffed"]["corrected"]
    assert out[2]["sniffed"] == out[9]["sniffed"]
    assert [e["type"] for e in out[6]["sniffed"]["embedded"]] == ["application/pdf"]
    nothing = M.inspect(docs.select("doc_id", F.lit(None).cast("binary").alias("media"))).first()
    assert nothing["sniffed"]["detected"] == M.UNKNOWN
    assert M.inspect(docs.where("false").withColumn("media", M.store(F.col("text")))).count() == 0


def test_op5(spark, tmp_path):
    texts = ["", None, "some text", "y" * 128]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in M.op5(spark, str(tmp_path)).collect():
        data = (texts[r["doc_id"]] or "").encode()
        want = M.padded(data)
        stored = M.wav(want)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(data), len(want), len(stored))
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest() and r["media_sha256"] == hashlib.sha256(stored).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(want[-64:])
