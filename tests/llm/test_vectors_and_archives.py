"""Operators 11 to 13 against brute force, SQL and exact round trips."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
import zstandard

from boardlake.llm import centroids, vector_codes, warc_zst
from boardlake.llm.common import shared_path

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, v string, wz_id string, code string, of_label string"


def rows_of(vectors):
    return [(i, v, label, "x", "x", "x", "x", "x") for i, v, label in vectors]


def odd_vectors(width, seed=1, n=700):
    """Random vectors with ties and repeats, a third of them one vector, and rows that are left out."""
    rng = np.random.default_rng(seed)
    grid = [(int(i), [float(np.float32(x)) for x in v], int(rng.integers(3)) if rng.random() < 0.8 else None)
            for i, v in zip(rng.permutation(n), rng.integers(-3, 4, (n, width)) / 64)]
    grid += [(n + i, grid[0][1], 1) for i in range(n // 2)] + grid[:5] + [(None, grid[1][1], None), (None, grid[2][1], 2)]
    bad = [(9001, None, 1), (9002, [], 1), (9003, [1.0] * (width - 1), 1), (9004, [None] + [1.0] * (width - 1), 1),
           (9005, [float("nan")] + [0.0] * (width - 1), 2), (9006, [float("-inf")] + [0.0] * (width - 1), None)]
    return grid, bad


def integers(rows, scale):
    return np.floor(np.array([r[1] for r in rows], float) * scale).astype(np.int64)


def first_by_distance(x, books):
    d = ((x[:, None] - books[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


def moved(x, at, books):
    out = books.copy()
    for k in range(len(books)):
        if (at == k).any():
            out[k] = x[at == k].sum(0) // (at == k).sum()
    return out


def test_clusters_like_brute_force(spark):
    good, bad = odd_vectors(8)
    got = centroids.clusters(spark.createDataFrame(rows_of(good + bad), VECTORS), k=7, rounds=3, dims=8).collect()
    x = integers(good, 256)
    order = sorted(range(len(good)), key=lambda j: (good[j][0] is None, hashlib.sha256(f"2:{good[j][0]}".encode()).hexdigest(), x[j].tolist()))
    books = x[order[:7]]
    for _ in range(3):
        books = moved(x, first_by_distance(x, books)[0], books)
    at, d = first_by_distance(x, books)
    per = np.bincount(at, d, minlength=7).astype(int)
    sha = [hashlib.sha256(",".join(map(str, b.tolist())).encode()).hexdigest() for b in books]
    want = [(good[j][0], int(at[j]), int(d[j]), int(per[at[j]]), int(d.sum()), sha[at[j]]) for j in range(len(good))]
    key = lambda r: (r[0] is None, str(r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_clusters_edges(spark):
    good, bad = odd_vectors(64, n=5)
    few = centroids.clusters(spark.createDataFrame(rows_of(good[:3] + bad), VECTORS)).collect()
    assert [r["distance"] for r in few] == [0, 0, 0] and len({r["cluster"] for r in few}) == 3
    none = centroids.clusters(spark.createDataFrame(rows_of(bad), VECTORS))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    huge = [(i, [s * 3e38] * 64, 1) for i, s in enumerate([1, -1, 1, -1])]
    out = centroids.clusters(spark.createDataFrame(rows_of(huge), VECTORS), k=1, rounds=2).collect()
    assert len(out) == 4 and all(r["distance"] == 64 * 2 ** 54 for r in out) and out[0]["inertia"] == 4 * 64 * 2 ** 54


def test_cluster_plan_stays_in_the_jvm(spark):
    df = spark.createDataFrame(rows_of(odd_vectors(8)[0]), VECTORS)
    kept = centroids.kept_vectors(df, 8, 256)
    plan = kept.select("v", centroids.nearest(kept["v"], [[1] * 8, [2] * 8])["i"].alias("cluster"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan and plan.count("zip_with") == 1


def brute_codes(good, width, parts, entries, rounds, scale=1024):
    x = integers(good, scale)
    order = sorted(range(len(good)), key=lambda j: (good[j][0] is None, good[j][0] or 0, good[j][1]))
    w, found, books = width // parts, [], []
    for p in range(parts):
        v = x[:, p * w:(p + 1) * w]
        b = v[order[:entries]]
        for _ in range(rounds):
            b = moved(v, first_by_distance(v, b)[0], b)
        found.append(first_by_distance(v, b))
        books.append(b)
    code = ["".join(f"{int(at[j]):02x}" for at, _ in found) for j in range(len(good))]
    error = sum(d for _, d in found)
    sha = hashlib.sha256(",".join(str(i) for b in books for i in b.reshape(-1).tolist()).encode()).hexdigest()
    return [(good[j][0], code[j], int(error[j]), int(sum(e for e, g in zip(error, good) if g[2] == good[j][2])), sha) for j in range(len(good))]


@pytest.mark.parametrize("entries", [256, 20])
def test_codes_like_brute_force(spark, entries):
    good, bad = odd_vectors(16, seed=entries)
    got = vector_codes.vector_codes(spark.createDataFrame(rows_of(good + bad), VECTORS).repartition(5), entries=entries).collect()
    key = lambda r: (r[0] is None, str(r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute_codes(good, 16, 4, entries, 4), key=key)


@pytest.mark.parametrize("seed", range(4))
def test_masks_leave_the_nearest_entry(seed):
    """Candidates are exactly the entries within the radius in every dimension; the search is exact for any data."""
    rng = np.random.default_rng(seed)
    width, n = [1, 3, 16, 16][seed], [256, 65, 200, 1][seed]
    entries = rng.integers(-5, 6, (n, width)) * [1, 1, 1, 400][seed]
    entries[rng.integers(n)] = 10 ** 6
    x = np.concatenate([entries[:50], rng.integers(-9, 10, (300, width)), np.full((1, width), -(2 ** 27))])
    book = vector_codes.Codebook(entries)
    radius = rng.integers(0, 8, len(x))
    masks = book.candidates(x, radius)
    inside = (np.abs(x[:, None] - entries[None]) <= radius[:, None, None]).all(2)
    assert all(bool(masks[i, e >> 6] >> np.uint64(e & 63) & np.uint64(1)) == inside[i, e] for i in range(len(x)) for e in range(n))
    at, d = book.nearest(x)
    want = first_by_distance(x, entries)
    assert (at == want[0]).all() and (d == want[1]).all()


def test_codes_edges(spark):
    good, bad = odd_vectors(16, n=4)
    none = vector_codes.vector_codes(spark.createDataFrame(rows_of(bad[:2] + bad[3:]), VECTORS).where("vec_id <> 9003"))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    one = vector_codes.vector_codes(spark.createDataFrame(rows_of(good[:1]), VECTORS)).collect()
    assert [(r["code"], r["error"]) for r in one] == [("00000000", 0)]
    mixed = vector_codes.vector_codes(spark.createDataFrame(rows_of([(1, [1.0] * 8, None), (2, [2.0] * 8, None), (3, [1.0] * 12, 1)]), VECTORS)).collect()
    assert sorted(r["vec_id"] for r in mixed) == [1, 2]


PAGES = "page_id long, url string, html string, wz_id string, payload string, n string, frame string"


def odd_pages():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = ["<html><body>" + " ".join(word() for _ in range(rng.choice([5, 300, 900]))) + "</body></html>" for _ in range(60)]
    pages = [(i, f"https://host/{i}?q=é x\r\nWARC-Type: warcinfo", t) for i, t in enumerate(texts)]
    pages += [(100 + i, "u", "same " * 300) for i in range(200)] + [(400 + i, "u", "small") for i in range(5)]
    pages += [(299, "u", "same " * 300), (299, "u", "same " * 300), (None, "u", "same " * 300), (None, None, "alone " * 300), (None, None, "alone " * 300)]
    pages += [(500, None, None), (501, "u", ""), (502, "u", "x" * 999), (503, "u", "x" * 999), (504, "u", "é" * 500), (505, "u", "é" * 500)]
    pages += [(600, "u", "\r\n\r\n" + warc_zst.EMPTY_FRAME * 200), (601, "u", "".join(chr(rng.randrange(32, 50000)) for _ in range(300_000)))]
    return [(*p, "x", "x", "x", "x") for p in pages]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(odd_pages(), PAGES).repartition(4)
    path = shared_path(spark, "test-archives")
    warc_zst.write_archives(pages, path)
    read = warc_zst.read_archives(spark, path, payloads=True).collect()
    assert len(read) == pages.count()
    key = lambda r: str(r)
    stored = {(r["page_id"], r["payload_digest"]): r for r in read if r["record_type"] == "response"}
    for r in read:
        if r["record_type"] == "revisit":
            assert r["payload"] is None and stored[r["refers_to"], r["payload_digest"]]["payload_bytes"] == r["payload_bytes"]
        else:
            assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"]
    whole = [(r["page_id"], stored[r["refers_to"] if r["record_type"] == "revisit" else r["page_id"], r["payload_digest"]]["payload"].decode()) for r in read]
    assert sorted(whole, key=key) == sorted(((p[0], p[2] or "") for p in odd_pages()), key=key)
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url", "html").toArrow())
    cursor = con.execute(warc_zst.ORACLE)
    names = [x[0] for x in cursor.description]
    assert sorted((tuple(r[n] for n in names) for r in read), key=key) == sorted(cursor.fetchall(), key=key)
    assert {r["url"] for r in read if r["page_id"] == 7} == {"https://host/7?q=%C3%A9%20x%0D%0AWARC-Type:%20warcinfo"}


def test_archive_files_are_plain_zstandard(spark):
    """Any decoder reads the files with the dictionary of the first frame; each record is a frame with its checksum."""
    path = shared_path(spark, "test-archives")
    pages = spark.createDataFrame(odd_pages(), PAGES).repartition(2)
    warc_zst.write_archives(pages, path)
    plain = shared_path(spark, "test-archives")
    warc_zst.write_archives(pages, plain, dictionary=b"")
    with_words = without = 0
    for folder, first in ((path, b"\x5d\x2a\x4d\x18"), (plain, b"\x28\xb5\x2f\xfd")):
        for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).collect():
            data = bytes(r["content"])
            assert data[:4] == first
            words = None
            if first == b"\x5d\x2a\x4d\x18":
                size = int.from_bytes(data[4:8], "little")
                words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8:8 + size]))
                with_words += len(data) - size
                data = data[8 + size:]
            else:
                without += len(data)
            text = zstandard.ZstdDecompressor(dict_data=words).stream_reader(data, read_across_frames=True).read()
            assert text.count(b"WARC/1.1\r\n") == sum(1 for _ in warc_zst._records(memoryview(bytes(r["content"]))))
    assert with_words < without


def test_archives_of_nothing_and_of_few(spark):
    pages = spark.createDataFrame(odd_pages(), PAGES)
    out = warc_zst.archived(pages.limit(0))
    assert out.count() == 0 and out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert warc_zst.train_dictionary(pages.limit(1)) == b"" and warc_zst.archived(pages.limit(1)).count() == 1
    damaged = spark.createDataFrame([(bytearray(b"\x00\x01\x02\x03"),)], "content binary")
    with pytest.raises(ValueError):
        list(warc_zst._records(memoryview(bytes(damaged.first()["content"]))))
