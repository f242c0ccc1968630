"""Chat formatting: render whole conversations, encode once with offsets, mask tokens by binary search over turn spans.

A turn is rendered as <|im_start|>role newline text <|im_end|> newline. A role or text may hold anything: every run
`<|`, optional backslashes, is given one more backslash when rendered and loses one when read, so no control string
can come out of a text, and reading gives back exactly what was rendered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.llm.token_counts import PATTERN, VOCABULARY, encoder, vocabulary

START, END = "<|im_start|>", "<|im_end|>"
_TOKENIZERS: dict[int, tuple] = {}
_OPEN = re.compile(r"<(\\*)\|")
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    """`<|` becomes `<\\|`, `<\\|` becomes `<\\\\|`, and so on."""
    return _OPEN.sub(lambda m: "<\\" + m[1] + "|", text)


def unescape(text: str) -> str:
    return _OPEN.sub(lambda m: "<" + m[1][1:] + "|", text)


def escape_role(role: str) -> str:
    """Roles are escaped like texts, and their line ends too: a header is one line."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """(the conversation as one text, sorted spans of the texts of turns whose role is `learn`)."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text between turns")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text after the last turn")
    return turns


def mask_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, start, end): for every token that a span overlaps, the characters of it under the mask.

    Token starts and ends, and spans, are sorted. For each span, the first token that ends after its start and the first
    that starts at or after its end are found by binary search; a token across an edge keeps only its part inside.
    """
    low, high = np.array(spans, np.int64).reshape(-1, 2).T
    first, past = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left")
    n = np.where(low < high, np.maximum(past - first, 0), 0)
    span = np.repeat(np.arange(len(n)), n)
    token = np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n) + first[span]
    keep = starts[token] < ends[token]
    token, span = token[keep], span[keep]
    return token, np.maximum(low[span], starts[token]), np.minimum(high[span], ends[token])


def masked_ranges(masked: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Character ranges under the mask, each character once; tokens that share the bytes of a character share it too."""
    out: list[tuple[int, int]] = []
    for _, a, b in masked:
        if out and a < out[-1][1]:
            a = out[-1][1]
        if a >= b:
            continue
        if out and a == out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def tokenizer(raw: bytes) -> tuple:
    """(byte-level encoder with the two control strings, number of bytes of each token)."""
    import tiktoken

    if (key := hash(raw)) not in _TOKENIZERS:
        plain = encoder(raw)
        made = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=plain._mergeable_ranks, special_tokens={START: plain.n_vocab, END: plain.n_vocab + 1})
        size = np.zeros(plain.n_vocab + 2, np.int64)
        for token, rank in plain._mergeable_ranks.items():
            size[rank] = len(token)
        size[-2:] = len(START), len(END)
        _TOKENIZERS[key] = made, size
    return _TOKENIZERS[key]


def encode_with_offsets(text: str, made, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token ids, starts, ends) in characters. Tokens lie end to end in bytes; those within a character share it."""
    ids = made.encode_to_numpy(text, allowed_special="all").astype(np.int64)
    past = np.cumsum(size[ids])
    if text.isascii():
        return ids, past - size[ids], past
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    head = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # characters that begin before each byte
    return ids, head[past - size[ids] + 1] - 1, head[past]


def conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): turns in order of their number (null first), then role and text; null roles and texts are empty."""
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def formatted(rows: DataFrame, learn: str = "assistant", vocabulary_path: str = VOCABULARY, **columns: str) -> DataFrame:
    """(conv_id, formatted, token_ids, mask_token, mask_start, mask_end): one row for each conversation.

    The mask: tokens under it and the characters of the formatted text that each brings. Rows with equal ids are one
    conversation, and rows without an id are one, too; equal turn numbers go by role and text, repeated rows stay. Very
    long conversations are rendered whole: one row each. An empty table gives no rows. Other columns are not read.
    """
    raw = vocabulary(rows.sparkSession, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = tokenizer(raw.value)
        ints = pa.list_(pa.int32())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                drawn = [render([(t["role"], t["text"]) for t in turns], learn) for turns in part.column(1).to_pylist()]
                codes = [encode_with_offsets(text, made, size) for text, _ in drawn]
                masks = [mask_tokens(c[1], c[2], spans) for c, (_, spans) in zip(codes, drawn, strict=True)]
                lists = [[c[0] for c in codes], *([m[k] for m in masks] for k in range(3))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([t for t, _ in drawn]), *[pa.array([x.astype(np.int32) for x in own], ints) for own in lists]],
                    names=["conv_id", "formatted", "token_ids", "mask_token", "mask_start", "mask_end"],
                )

    return conversations(rows, **columns).mapInArrow(run, "conv_id long, formatted string, token_ids array<int>, mask_token array<int>, mask_start array<int>, mask_end array<int>")


def format_digests(done: DataFrame) -> DataFrame:
    """What is read back from formatted(): conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens."""
    kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64())]
    sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text = r["formatted"]
                turns = read_turns(text)
                ranges = masked_ranges(list(zip(r["mask_token"], r["mask_start"], r["mask_end"], strict=True)))
                loss = "".join(unescape(text[a:b]) for a, b in ranges)
                rows.append((r["conv_id"], len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss), len(text), len(r["token_ids"])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    return done.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
