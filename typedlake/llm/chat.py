"""Chat formatting with loss masks aligned through token offsets.

A conversation is rendered whole, encoded once with offsets, and the sorted
spans of its turns meet the token spans by binary search.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: The template's marks, each one token. Fixed values.
START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
#: Control strings of this and other templates; an escaped one has one more backslash after its bracket. Fixed values.
CONTROL = re.compile(r"(<)(\\*)(?=\||/?s>)|(\[)(\\*)(?=/?INST\])|(<<)(\\*)(?=/?SYS>>)")
ESCAPED = re.compile(r"(<)\\(\\*)(?=\||/?s>)|(\[)\\(\\*)(?=/?INST\])|(<<)\\(\\*)(?=/?SYS>>)")

#: How a text is cut before its pieces are encoded. A fixed value of byte-level vocabularies.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Runs of white space that the cutting can't take at once.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{50000,}")

FORMATTED = "formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "".join(g for g in m.groups() if g) + "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: "".join(g for g in m.groups() if g), text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and where each turn's text stands in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{MESSAGE}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns = []
    for part in formatted.split(END)[:-1]:
        role, text = part.removeprefix(START).split(MESSAGE, 1)
        turns.append((unescape(role), unescape(text)))
    return turns


def mask_of(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]], chosen: list[bool]) -> np.ndarray:
    """Which tokens lie in a chosen span: for each token the last span that begins at or before it."""
    if not spans or not len(starts):
        return np.zeros(len(starts), bool)
    first, last = np.array(spans).T
    at = np.searchsorted(first, starts, "right") - 1
    own = np.maximum(at, 0)
    return (at >= 0) & (starts < last[own]) & (ends <= last[own]) & np.array(chosen)[own]


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The runs of text that the masked tokens cover, as they stand in the formatted string."""
    a, b = starts[mask], ends[mask]
    if not len(a):
        return []
    new = np.concatenate(([True], a[1:] > np.maximum.accumulate(b)[:-1]))
    begin = a[new]
    stop = np.maximum.reduceat(b, np.flatnonzero(new))
    return [formatted[x:y] for x, y in zip(begin, stop, strict=True)]


class Encoder:
    """A byte-level encoder with the template's marks, from the lines of a rank file; offsets follow from the tokens' bytes."""

    def __init__(self, lines: bytes) -> None:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines.splitlines() if line.strip())}
        first = max(ranks.values()) + 2
        self.marks = {mark: first + k for k, mark in enumerate((START, MESSAGE, END))}
        self.encoding = tiktoken.Encoding("chat", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=self.marks)
        self.allowed = set(self.marks)
        self.lengths = np.zeros(first + len(self.marks), np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        for mark, rank in self.marks.items():
            self.lengths[rank] = len(mark)

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())
        except ValueError:  # white space too long for the cutting: the same pieces, cut by hand
            return np.array([i for part in re.split("(" + "|".join(map(re.escape, self.marks)) + ")", text) for i in self._cut(part)], np.uint32)

    def _cut(self, part: str) -> list[int]:
        if part in self.marks:
            return [self.marks[part]]
        out, at = [], 0
        for run in LONG_SPACE.finditer(part):
            end = run.end() - (run.end() < len(part))  # the last one goes with what follows
            out += self.encoding.encode_ordinary(part[at : run.start()]) + self.encoding._encode_single_piece(part[run.start() : end])
            at = end
        return out + self.encoding.encode_ordinary(part[at:])

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each token starts and ends in code points; a token within a character has the whole of it."""
        ids = self.ids(text)
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        if not text.isascii():
            place = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
            starts, ends = place[starts] - 1, place[ends - 1]
        return ids.astype(np.int32), starts.astype(np.int32), ends.astype(np.int32)


def format_chats(conversations: DataFrame, tokenizer: str, learn: tuple[str, ...] = ("assistant",), id_col: str = "conv_id") -> DataFrame:
    """Render, encode and mask every conversation.

    Turns are ordered by turn, then role, then text; repeated rows are turns of
    their own; a null text or role counts as empty. Rows without an id are one
    conversation. A conversation is one unit and goes to one task whole; an
    empty table gives an empty result; other columns are not read. The loss
    mask is over tokens and covers the texts of the roles in learn, without
    the marks around them. tokenizer names a rank file of a byte-level
    vocabulary, which is read on the driver and sent
    to the tasks (a few MB); its marks are added as tokens, so no token runs
    over the edge of a turn.

    Returns id_col, formatted, token_ids, token_starts, token_ends (offsets
    in code points) and loss_mask.
    """
    with open(tokenizer, "rb") as f:
        vocabulary = conversations.sparkSession.sparkContext.broadcast(f.read())
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy(id_col).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(vocabulary.value)
        for pdf in parts:
            out: dict[str, list] = {k: [] for k in ("formatted", "token_ids", "token_starts", "token_ends", "loss_mask")}
            for turns in pdf["turns"]:
                pairs = [(t["role"], t["text"]) for t in turns]
                text, spans = render(pairs)
                ids, starts, ends = encoder.encode(text)
                mask = mask_of(starts, ends, spans, [role in learn for role, _ in pairs])
                for k, v in zip(out, (text, ids, starts, ends, mask), strict=True):
                    out[k].append(v)
            yield pd.DataFrame({id_col: pdf[id_col], **out})

    kind = dict(conversations.dtypes)[id_col]
    return whole.mapInPandas(run, f"{id_col} {kind}, {FORMATTED}")


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of formatted conversations, from the formatted string, the token offsets and the mask alone."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for text, starts, ends, mask in zip(pdf["formatted"], pdf["token_starts"], pdf["token_ends"], pdf["loss_mask"], strict=True):
                turns = parse(text)
                learnt = "".join(unescape(t) for t in masked_text(text, np.asarray(starts), np.asarray(ends), np.asarray(mask, bool)))
                said = "".join(f"{role}\n{t}\n" for role, t in turns)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            columns = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pd.concat([pdf[[id_col]].reset_index(drop=True), pd.DataFrame(rows, columns=columns)], axis=1)

    kind = dict(formatted.dtypes)[id_col]
    return formatted.mapInPandas(run, f"{id_col} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
