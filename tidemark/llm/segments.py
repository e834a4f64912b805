"""Cut texts where a byte-level BPE tokenizer must start a new piece whatever stands around.

A space between two characters that are no white space begins a new piece of the
pre-tokenizer's pattern, so a text's tokens are those of its segments one after
another.  Segments repeat, so each distinct one of a batch is encoded once.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

BPE = "byte_bpe_50k"
# The string that the tokenizer finds in plain text, and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256

_CUT = re.compile(r"(?<=\S) (?=\S)")
# White space at an end or next to white space, for any character that either library calls white space.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NOT_PLAIN = f"^{_SPACE}|{_SPACE}\\z|{_SPACE}{_SPACE}|{re.escape(SPECIAL)}"


def pieces(text: str) -> list[str]:
    """The text between its sure cuts; all but the first begin with their space."""
    first, *rest = _CUT.split(text)
    return [first, *[" " + x for x in rest]]


def plain(texts: pa.Array) -> np.ndarray:
    """Which texts are non-empty and are cut right by splitting at every space."""
    odd = pc.or_(pc.match_substring_regex(texts, _NOT_PLAIN), pc.equal(pc.binary_length(texts), 0))
    return ~odd.to_numpy(zero_copy_only=False)


class Encoder:
    """The vocabulary's ranks as a plain encoder; gives the ids of the .json file, which fit in 16 bits."""

    def __init__(self, path: str | None = None):
        with open(path or public_tokenizers.path(f"{BPE}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokenizer = tiktoken.Encoding(
            BPE, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.n_bytes = np.zeros(1 << 16, np.int64)
        self.sentence_end = np.zeros(1 << 16, bool)
        for token, i in ranks.items():
            self.n_bytes[i] = len(token)
            self.sentence_end[i] = token[-1:] in (b".", b"!", b"?", b"\n")

    def ids(self, text: str) -> np.ndarray:
        """Ids of one text, in which the special string has its own id."""
        parts = []
        for i, part in enumerate(text.split(SPECIAL)):
            parts += [[SPECIAL_ID]] * (i > 0)
            parts.append(self.tokenizer.encode_ordinary(part))
        return np.fromiter((x for p in parts for x in p), np.uint16, sum(map(len, parts)))

    def table(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct segments, each after a space, and the bounds of each one's ids.

        All are encoded as one text, as every segment's space is a sure cut, and
        told apart by their numbers of bytes.
        """
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(segments)], pa.int32()), segments), " ")
        ids = np.array(self.tokenizer.encode_ordinary(" " + whole[0].as_py() if len(segments) else ""), np.uint16)
        upto = np.cumsum(self.n_bytes[ids])
        wanted = np.cumsum(pc.binary_length(segments).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        return ids, np.r_[0, np.searchsorted(upto, wanted) + 1]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the bounds of each text's ids."""
        easy = plain(texts)
        where = np.flatnonzero(easy)
        lists = pc.split_pattern(texts.take(pa.array(where)), " ")
        begins = lists.offsets.to_numpy()
        coded = lists.values.slice(begins[0], begins[-1] - begins[0]).dictionary_encode()
        begins = begins - begins[0]
        codes = coded.indices.to_numpy().astype(np.int32)
        ids, bounds = self.table(coded.dictionary)
        # First segments have no space before them, and odd texts are encoded whole: one more entry each.
        firsts = coded.dictionary.take(pa.array(codes[begins[:-1]])).to_pylist()
        single = [self.ids(x) for x in firsts]
        odd = [self.ids(x) for x in texts.filter(pa.array(~easy)).to_pylist()]
        codes[begins[:-1]] = len(bounds) - 1 + np.arange(len(single), dtype=np.int32)
        more = single + odd
        sizes = np.r_[np.diff(bounds), np.array([len(x) for x in more], np.int64)].astype(np.int32)
        table = np.concatenate([ids, *more]) if more else ids
        # Entries in the order of the texts.
        per_text = np.ones(len(texts), np.int64)
        per_text[where] = np.diff(begins)
        first = np.r_[0, np.cumsum(per_text)]
        entries = np.empty(first[-1], np.int32)
        at_odd = first[:-1][~easy]
        mask = np.ones(len(entries), bool)
        mask[at_odd] = False
        entries[mask] = codes
        entries[at_odd] = len(bounds) - 1 + len(single) + np.arange(len(odd), dtype=np.int32)
        grouped = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(table))
        taken = grouped.take(pa.array(entries))
        return taken.flatten().to_numpy(), taken.offsets.to_numpy()[first]


@cache
def shared_encoder() -> Encoder:
    """The one encoder of a worker; its tables are large and are kept from task to task."""
    return Encoder()
