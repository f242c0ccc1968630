"""Language ID and toxicity: gradients, segments, held-out accuracy; TIFF round trips; the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from ledgertide.llm import language_id as lang
from ledgertide.llm import media_tiff as tiff
from ledgertide.llm import toxicity as tox

SF = "/root/testdata/sf0.01"


def test_gradients():
    net = lang.ByteGru(3, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    data, mask, label = rng.integers(97, 103, (7, 5)).astype(np.uint8), np.ones((7, 5)), np.array([0, 1, 2, 0, 1])
    mask[5:, 2] = 0
    _, grads = net.gradients(data, mask, label)
    for name, value in net.p.items():
        at = (2, int(data[1, 1])) if name == "emb" else tuple(0 for _ in value.shape)
        old, step = value[at], 1e-2
        value[at] = old + step
        up = net.gradients(data, mask, label)[0]
        value[at] = old - step
        down = net.gradients(data, mask, label)[0]
        value[at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-4)


def test_language(spark, odd, odd_rows, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = lang.predict_language(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and out.score.between(0, 1).all()
    few = lang.predict_language(odd).toPandas()
    assert len(few) == len(odd_rows) and (few[few.doc_id.isin([0, 1, 2])].lang_pred == "und").all()
    assert lang.predict_language(nothing).count() == 0


def brute_segments(score):
    """The recursive definition: the best segment (shortest, then first), then left and right of it."""
    best = max(((score[a:b].sum(), -(b - a), -a) for a in range(len(score)) for b in range(a + 1, len(score) + 1)), default=(0, 0, 0))
    if best[0] <= 1e-12:
        return []
    a, b = -best[2], -best[2] - best[1]
    return [*brute_segments(score[:a]), (a, b), *[(x + b, y + b) for x, y in brute_segments(score[b:])]]


def test_segments():
    rng = np.random.default_rng(2)
    for _ in range(200):
        score = rng.standard_normal(rng.integers(0, 18))
        assert [(a, b) for a, b, _ in tox.maximal_segments(score)] == brute_segments(score)


def test_toxicity(spark, odd, odd_rows, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = tox.fit_toxicity(docs, labels)
    out = tox.score_toxicity(docs, model).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    assert ((held.predicted == 1) & (held.toxic == 1)).sum() / (held.predicted == 1).sum() > 0.9
    assert ((held.predicted == 1) & (held.toxic == 1)).sum() / (held.toxic == 1).sum() > 0.75
    few = tox.score_toxicity(odd, model, passages=True).toPandas()
    assert len(few) == len(odd_rows) and few.score.between(0, 1).all()
    assert tox.score_toxicity(nothing, model).count() == 0
    empty = tox.fit_toxicity(nothing, labels.limit(0))
    assert tox.score_toxicity(odd, empty).count() == len(odd_rows)


def test_toxicity_without_calibration(spark, odd, odd_rows):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = tox.fit_toxicity(docs, labels.limit(0))
    assert tox.score_toxicity(odd, model).where("predicted = 1").count() == 0
    assert tox.without_toxic(odd, model).count() == len(odd_rows)
    free = [k for k in range(200) if zlib.crc32(str(k).encode()) % 4 != 2]
    rows = spark.createDataFrame([(k, f"text number {k}") for k in free], "doc_id long, text string")
    for toxic, kept in ((0, True), (1, False)):  # one class only
        some = tox.fit_toxicity(rows, rows.selectExpr("doc_id", f"{toxic} AS toxic"))
        assert (tox.without_toxic(odd, some).count() == len(odd_rows)) == kept


def test_tiff_layouts():
    rng = random.Random(1)
    for n in (0, 64, 65, 5000, 300_000):
        payload = tiff.payload_of(bytes(rng.choice(b"abcdefgh ") for _ in range(n)))
        pages = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        for kind in (tiff.NONE, tiff.PACKBITS, tiff.DEFLATE, *([tiff.LZW] if n < 10_000 else [])):
            for predictor, tile, order in ((1, 0, "<"), (2, 0, ">"), (2, 16, "<"), (1, 64, ">")):
                made = tiff.write_pages([pages[k : k + 4096] for k in range(0, len(pages), 4096)], kind, predictor, tile, 100, order)
                assert b"".join(p.pixels.tobytes() for p in tiff.read_pages(made)) == payload
    for data in (b"", b"a", b"aaa", bytes(range(256)) * 40, b"ab" * 9000):
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data and tiff.packbits_decode(tiff.packbits_encode(data)) == data


def test_media(spark, odd, odd_rows, nothing):
    got = tiff.media_digests(odd).toPandas()
    want = sorted((-1 if i is None else i, hashlib.sha256(tiff.payload_of((t or "").encode())).hexdigest(), zlib.crc32(tiff.payload_of((t or "").encode())[-64:])) for i, t in odd_rows)
    assert sorted((-1 if np.isnan(r.doc_id) else int(r.doc_id), r.payload_sha256, r.tail_crc32) for r in got.itertuples()) == want
    assert tiff.media_digests(nothing).count() == 0
    files = spark.createDataFrame([(1, bytearray(tiff.stored_form(tiff.payload_of(b"x" * 400_000)))), (2, bytearray(b"junk")), (3, None)], "id long, media binary")
    pages = tiff.tiff_pages(files, "id", "media").collect()
    assert len([r for r in pages if r.id == 1 and r.error is None]) == 2 and all(r.error for r in pages if r.id != 1)


def test_pipeline_stages(spark, odd):
    from test_llm_pairs import brute_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert kept == {i for i, (_, c) in brute_components(rows).items() if i == c}
    clean = {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, SF).collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {i for i, t in rows if any(" ".join(x.lower().split()) in " ".join(t.lower().split()) for x in items)}
    assert whole and clean == {i for i, _ in rows} - whole
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, odd, SF).count() > 0
    assert corpus_pipeline.mixing(spark, odd, SF).count() == odd.count()


def test_toxicity_does_not_depend_on_layout(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = []
    for n in (1, 16, 61):
        model = tox.fit_toxicity(docs.repartition(n), labels.repartition(n))
        found.append({r.doc_id: (r.score, r.predicted) for r in tox.score_toxicity(docs, model).collect()})
    assert found[0] == found[1] == found[2]
    assert {r.doc_id for r in tox.without_toxic(docs, model).collect()} == {k for k, (_, p) in found[0].items() if not p}


def test_toxicity_score_against_plain_code(spark):
    """The score of each text from its tokens' scores and the model's figures, without any shared code but the model."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = tox.fit_toxicity(docs, labels)
    got = {r.doc_id: r.score for r in tox.score_toxicity(docs, model).collect()}
    for r in docs.limit(60).collect():
        raw = (r.text or "").encode()
        codes = tox.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        own = [s - np.log(model.scale * max(len(codes), 1)) for s in (model.rate * model.score[codes][a:b].sum(dtype=float) for a, b in brute_fast(model.score[codes].astype(float)))]
        strong = sum(e > 0 for e in own)
        x = model.weights[0] + model.weights[1] * min(max([0.0, *own]), 30.0) + model.weights[2] * np.log1p(strong) + model.weights[3] * (strong > 1)
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-x)), abs=1e-6)


def brute_fast(score):
    """Maximal segments by the recursive definition, best segment by Kadane's scan."""
    best, total, low, at, where = 1e-12, 0.0, 0.0, 0, None
    for k, s in enumerate(score.tolist()):
        if total <= low:
            low, at = total, k
        total += s
        if total - low > best + 1e-12:
            best, where = total - low, (at, k + 1)
    if where is None:
        return []
    a, b = where
    return [*brute_fast(score[:a]), where, *[(x + b, y + b) for x, y in brute_fast(score[b:])]]


def test_least_hashes(spark):
    from ledgertide.llm.common import least_hashes

    rng = random.Random(4)
    rows = [(g, rng.getrandbits(64) - 2**63) for g in "aab" for _ in range(300)] + [("c", 5), ("c", 5), ("c", 6)]
    df = spark.createDataFrame(rows, "g string, h long")
    for most in (1, 50, 1000):
        got = sorted((r.g, r.h) for r in least_hashes(df.repartition(5), "g", "h", most).collect())
        want = []
        for g in "abc":
            own = sorted((h for k, h in rows if k == g), key=lambda h: (h % 2**64 >> 44, h))
            want += [(g, h) for h in own if sum((x % 2**64 >> 44, x) < (h % 2**64 >> 44, h) for x in own) < most]
        assert got == sorted(want)


def test_broken_tiffs(spark):
    payload = tiff.payload_of(b"abc" * 100)
    page = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    rng, files = random.Random(7), [b"", b"II*\0", b"MM\0*" + b"\xff" * 40]
    for kind in (tiff.NONE, tiff.PACKBITS, tiff.DEFLATE, tiff.LZW):
        for tile in (0, 16):
            good = tiff.write_pages([page], kind, 1, tile, 3)
            files += [good[:k] for k in rng.sample(range(len(good)), 12)]
            for _ in range(60):
                bad = bytearray(good)
                for _ in range(rng.randint(1, 4)):
                    bad[rng.randrange(len(bad))] = rng.choice([0, 1, 255, rng.randrange(256)])
                files.append(bytes(bad))
    for tag, value in ((tiff.ROWS_PER_STRIP, 0), (tiff.WIDTH, 2**31 - 1), (tiff.LENGTH, 2**31 - 1)):
        bad = bytearray(tiff.write_pages([page], tiff.DEFLATE))
        at = bad.index(tag.to_bytes(2, "little") + b"\4\0")
        bad[at + 8 : at + 12] = value.to_bytes(4, "little")
        files.append(bytes(bad))
    rows = tiff.tiff_pages(spark.createDataFrame([(k, bytearray(f)) for k, f in enumerate(files)], "id long, media binary"), "id", "media").collect()
    assert {r.id for r in rows} == set(range(len(files))) and all(r.error for r in rows if r.id in (0, 1, 2) or r.id >= len(files) - 3)


def test_codec_vectors():
    """Vectors that were not made by this writer."""
    assert tiff.packbits_decode(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]  # the worked example of the format's description: 7 7 7 8 8 7 7 6 6
    bits = "".join(f"{c:09b}" for c in codes)
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(packed) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) == tiff.lzw_decode(tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])))


def test_every_layout_is_used(spark):
    got = tiff.media_digests(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    layouts = got.feature.str.extract(r"compression=(\d+);predictor=(\d);tiled=(\d)").value_counts(normalize=True)
    assert len(layouts) == 8 and layouts.min() > 0.05
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in got.itertuples():
        media = tiff.stored_form(tiff.payload_of(texts[r.doc_id]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        counts = np.bincount(np.frombuffer(tiff.payload_of(texts[r.doc_id]), np.uint8), minlength=256)
        assert f"distinct={(counts > 0).sum()}" in r.feature


def test_logistic_converges_when_newton_steps_overshoot():
    from ledgertide.llm.toxicity import features, logistic

    rng = np.random.default_rng(1)
    y = (rng.random(20_000) < 0.4).astype(float)
    evidence = np.where(y > 0, rng.exponential(60, len(y)), np.where(rng.random(len(y)) < 0.01, 5.0, 0.0))
    x = features(evidence, (evidence > 4).astype(float))
    w = logistic(x, y)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    assert np.abs(x.T @ (y - p) - 1e-2 * w).max() < 1e-3
    assert ((p >= 0.3) == (y > 0)).mean() > 0.9
