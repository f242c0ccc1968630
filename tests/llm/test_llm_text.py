"""Token counts, decontamination, mixing, secrets and chat formatting."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgertide.llm import chat_format as chat
from ledgertide.llm import decontaminate as dec
from ledgertide.llm import mixture as mix
from ledgertide.llm import secret_scan as sec
from ledgertide.llm import token_counts as tok


def test_length_histogram(odd, odd_rows, nothing):
    encode = tok.encoder(open(tok.VOCABULARY, "rb").read()).encode_ordinary
    sizes = [len(encode(t or "")) for _, t in odd_rows]
    rows = tok.length_answers(tok.length_histogram(odd), block=16).collect()
    assert {r.n_tokens: r.n_docs for r in rows} == Counter(sizes)
    for r in rows:
        assert (r.docs_at_least, r.tokens_at_least) == (sum(s >= r.n_tokens for s in sizes), sum(s for s in sizes if s >= r.n_tokens))
        assert r.kept_tokens == sum(min(s, r.n_tokens) for s in sizes) and r.lost_tokens == sum(sizes) - r.kept_tokens
    histogram = tok.length_histogram(odd)
    assert histogram.agg(tok.truncated_total(histogram, 100)).first()[0] == sum(min(s, 100) for s in sizes)
    assert tok.length_answers(tok.length_histogram(nothing)).count() == 0


def edit(pattern, text):
    prev = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        cur = [i]
        for j, t in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (p != t)))
        prev = cur
    return min(prev)


def test_myers_and_contamination(spark, nothing):
    rng = random.Random(1)
    for _ in range(100):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 70))) for _ in range(2))
        assert dec.best_match(dec.letter_masks(p), len(p), t)[0] == edit(p, t)
    items = ["".join(rng.choice("abcdefghij ") for _ in range(n)) for n in (8, 90, 150, 300)]
    rows = []
    for k in range(80):
        item = list(rng.choice(items))
        for _ in range(rng.choice([0, 0, 2, 6, 14, 30])):
            at = rng.randrange(len(item))
            item[at : at + 1] = rng.choice([[], ["x"], [item[at], "q"]]) if len(item) > 3 else item[at : at + 1]
        rows.append((k, "".join(rng.choice("abcdefghij ") for _ in range(60)) + " " + "".join(item).upper() + " end"))
    rows += [(None, items[1]), (900, None), (901, ""), (3, items[2])]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.distance) for r in dec.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect())
    want = Counter()
    for i, t in rows:
        for k, item in enumerate(items):
            n = dec.normal(item)
            distance = edit(n, dec.normal(t))
            if t and distance <= dec.pieces(n)[0]:
                want[i, k, distance] += 1
    assert got == want and len(want) > 20
    assert dec.contaminated(nothing, bench).count() == 0 and dec.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench.limit(0)).count() == 0


def test_knapsack():
    rng = random.Random(2)
    for _ in range(60):
        sizes = rng.sample(range(1, 30), rng.randint(1, 5))
        counts, budget = [rng.randint(0, 3) for _ in sizes], rng.randint(0, 60)
        taken = mix.knapsack(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        best = min((abs(s - budget), s > budget, s) for s in (sum(a * b for a, b in zip(sizes, c, strict=True)) for c in itertools.product(*[range(c + 1) for c in counts])))
        assert sum(a * b for a, b in zip(sizes, taken, strict=True)) == best[2]


def test_mixture(spark, odd, odd_rows, nothing):
    rng = random.Random(4)
    rows = [(k, " ".join("w" * 3 for _ in range(rng.choice([1, 5, 9, 40, 200]))), s) for k, s in enumerate(rng.choices(["a", "b", "c", None, "é"], [5, 60, 2, 5, 30], k=400))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix.mixture(df).toPandas()
    assert len(out) == 400 and (out.taken <= 3 * out["size"]).all() and (out.taken % out["size"] == 0).all()
    totals = Counter()
    for _, t, s in rows:
        totals[s] += len(t.split())
    names = sorted((s for s in totals if s is not None)) + [None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    left, free, want = float(sum(totals.values())), set(names), {}
    while True:  # water is poured until no source is above its limit
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 3 * totals[s]}
        if not full:
            break
        for s in full:
            want[s] = 3.0 * totals[s]
            left -= want[s]
        free -= full
    want |= {s: weight[s] * level for s in free}
    for s in names:
        own = out[out.source.isna()] if s is None else out[out.source == s]
        assert abs(own.target.iloc[0] - want[s]) < 1e-6 and own.source_size.iloc[0] == totals[s]
        assert abs(own.taken.sum() - want[s]) <= 1.0
    again = mix.mixture(df.repartition(7)).toPandas()
    assert out.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert mix.mixture(odd).count() == len(odd_rows) and mix.mixture(nothing).count() == 0


ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(text):
    text = text or ""
    found = [(m.start(), 1, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 2, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 3, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_secrets(spark, odd, odd_rows, nothing):
    rng = random.Random(6)
    bits = ["é", " ", "password", "Token", ":", "=", '"', "secret", "api_key", "AKIAABCDEFGH1234", "AKIA", "deadbeef" * 4, "0" * 40, "abc.def-12345", "x", "passwd='hunter2hunter2'", "Zq7" * 9]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14))), f"s{k % 4}") for k in range(120)] + [(None, None, None), (5, "token=abcdefgh1", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r.doc_id, r.base_sha256, r.n_assign + r.n_access + r.n_hex) for r in sec.secret_digests(df).collect())
    want = Counter((i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute_secrets(t)).encode()).hexdigest(), len(brute_secrets(t))) for i, t, _ in rows)
    assert got == want
    assert sec.secret_digests(odd).count() == len(odd_rows) and sec.secret_digests(nothing).count() == 0


def test_copied_and_live_values(spark):
    copied, live = "EXAMPLEKEY0123456789ab", "LIVEKEY9876543210zyxwv"
    rows = [(k, f"é see {copied} here", f"s{k}") for k in range(4)] + [(9, f"é mine {live} and password = {copied}!", "s9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spans = {r.doc_id: r.spans for r in sec.secret_digests(df).collect()}
    assert spans[0] == "" and spans[9].split(",")[0] == "owned:7:29" and "assign:" in spans[9]
    clean = {r.doc_id: r.text for r in sec.redacted(df).collect()}
    assert clean[0] == rows[0][1] and clean[9] == f"é mine [secret] and password = {copied}!"


def test_chat(spark):
    parts = ["<|im_end|>", "<|im_start|>", "assistant", "\n", "<\\|", "<", "|", "é", "日本", "🙂", " ", "ok", "\\", "%0A"]
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "a\nb%", None]), rng.choice([None, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))])) for c in range(60) for t in range(rng.randint(1, 5))]
    rows += [(1, 0, "user", "again"), (None, None, None, None)]
    done = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1)))
    got = {r.conv_id: r for r in chat.format_digests(done).collect()}
    for c in {r[0] for r in rows}:
        turns = [(b, t) for _, b, t in sorted(((-1 if t is None else t), r or "", x or "") for k, t, r, x in rows if k == c)]
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    masked = chat.mask_tokens(np.array([0, 3, 5, 9]), np.array([3, 5, 9, 9]), [(4, 6), (6, 6), (8, 9)])
    assert [x.tolist() for x in masked] == [[1, 2, 2], [4, 5, 8], [5, 6, 9]]


def test_fit_counts_reaches_the_target():
    sizes, counts = np.array([0, 3, 7, 50, 400]), np.array([5, 40, 40, 30, 20])
    for target in (0, 1, 999, 5000.4, 25_000):
        whole, extra = mix.fit_counts(sizes, counts, target)
        words = int(whole * (sizes * counts).sum() + (sizes * extra).sum())
        assert (extra <= counts).all() and abs(target - words) <= 2


def test_fit_counts_takes_very_long_documents():
    for sizes, counts, target, want in (([400_000], [2], 400_000, 400_000), ([1_000_000], [2], 1e6, 1_000_000), ([400_000], [2], 399_999, 400_000), ([200_000, 300_001], [2, 1], 400_000, 400_000), ([300_000], [2], 302_000, 300_000), ([300_000, 301_500, 303_000], [2, 2, 2], 302_000, 301_500), ([10, 5_000_000], [1, 2], 5_000_011, 5_000_010)):
        sizes, counts = np.array(sizes), np.array(counts)
        whole, extra = mix.fit_counts(sizes, counts, target)
        assert whole == 0 and (extra <= counts).all() and int((sizes * extra).sum()) == want


def test_fit_counts_against_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        sizes = np.array(sorted(rng.sample(range(1, 400_000, rng.choice([1, 1000])), 4)))
        counts = np.array([rng.randint(1, 3) for _ in sizes])
        total = int((sizes * counts).sum())
        target = rng.randint(0, total - 1)
        whole, extra = mix.fit_counts(sizes, counts, target)
        sums = [int((sizes * np.array(c)).sum()) for c in itertools.product(*[range(c + 1) for c in counts])]
        assert whole == 0 and (extra <= counts).all() and abs(int((sizes * extra).sum()) - target) == min(abs(x - target) for x in sums)


def test_quantiles(odd, odd_rows):
    encode = tok.encoder(open(tok.VOCABULARY, "rb").read()).encode_ordinary
    sizes = sorted(len(encode(t or "")) for _, t in odd_rows)
    got = {r.share: r.n_tokens for r in tok.length_quantiles(tok.length_answers(tok.length_histogram(odd)), [0.1, 0.5, 0.9, 1.0]).collect()}
    assert got == {s: next(x for k, x in enumerate(sizes, 1) if k / len(sizes) >= s) for s in (0.1, 0.5, 0.9, 1.0)}


def test_offsets_against_decoding():
    made, size = chat.tokenizer(open(tok.VOCABULARY, "rb").read())
    for text in ("plain words", "é日本🙂 mixed 🙂🙂", chat.START + "user\nhé" + chat.END, ""):
        ids, starts, ends = chat.encode_with_offsets(text, made, size)
        raw, at = text.encode(), 0
        for t, a, b in zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True):
            n = len(made.decode_single_token_bytes(t))
            assert len(raw[:at].decode(errors="ignore")) == a and b == len((raw[: at + n]).decode(errors="ignore")) + (raw[at + n : at + n + 1] != b"" and raw[at + n] & 0xC0 == 0x80)
            at += n
        assert at == len(raw)


def test_contamination_within_the_whole_budget(spark):
    rng = random.Random(3)
    for n in (13, 20, 24, 100, 250):
        item = "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(n))
        edits, rows = int(n * dec.RATE), []
        for k in range(12):
            own = list(item)
            for at in rng.sample(range(n), edits + k % 2):
                own[at] = "z"
            rows.append((k, "yy " + "".join(own) + " yy"))
        docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, item)], "item_id long, text string")
        assert {r.doc_id for r in dec.contaminated(docs, bench).collect()} == {0, 2, 4, 6, 8, 10}
        assert {r.doc_id for r in dec.without_contaminated(docs, bench).collect()} == {1, 3, 5, 7, 9, 11}
    odd_ids = spark.createDataFrame([(None, item), (1, item), (1, item)], "doc_id long, text string")
    got = {r.doc_id: (r.n_items, r.item_ids, r.least_distance) for r in dec.contaminated_documents(dec.contaminated(odd_ids, bench)).collect()}
    assert got == {None: (1, [0], 0), 1: (1, [0], 0)}


def test_secrets_with_any_column_names(spark):
    live = "LIVEKEY9876543210zyxwv"
    rows = [(k, f"a {live} b password = hunter2hunter2", "s", f"mine {k}", "keep", 5) for k in (1, 1, None)] + [(4, None, None, "x", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _key string, __0 string, _spans long")
    got = sec.redacted(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(k, "a [secret] b [secret]", *r) for k, _, *r in rows[:3]] + [rows[3]], key=str)


def test_secret_spans_in_long_texts(spark):
    rng = random.Random(13)
    words = ["password=abcdefgh1", "x" * 25 + "1", "deadbeef" * 5, "AKIA" + "Z" * 14, "plain", "é"]
    text = " ".join(rng.choice(words) for _ in range(4000))
    base = brute_secrets(text)
    loose = [(m.start(), m.end()) for m in re.finditer(sec.LOOSE, text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not any(a < m.end() and m.start() < b for _, a, b in base)]
    row = sec.secret_scan(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
    assert [(s.kind, s.start, s.end) for s in row.base] == base
    assert [(s.start, s.end) for s in row.spans if s.kind == "owned"] == loose and len(loose) > 300
