"""Byte-level BPE encoding in tasks, with the ids of each distinct chunk of text kept.

Byte-level BPE never merges across the start of a run of white space, nor from a letter to
punctuation.  A text is therefore cut there, each distinct chunk is encoded once by the public
tokenizer's own library, and the ids of a text are its chunks' ids joined.  ``vocabulary`` is always a path.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np

#: Unicode's White_Space, fixed values as the tokenizers' pattern ``\s`` takes them.
WHITE = "\t-\r \x85\xa0  -     　"
#: A run of white space but for its last character if a word follows; a word of plain letters
#: and digits before ASCII punctuation; else all up to the next white space.  A leading white
#: space character belongs to the chunk.
CHUNK = re.compile(
    f"[{WHITE}]+(?![^{WHITE}])|[{WHITE}]?+[A-Za-z0-9À-ÖØ-öø-ÿ]++(?=[!-/:-@\\[-`{{-~])|[{WHITE}]?[^{WHITE}]+"
)
#: Runs of white space too long for a look-ahead.
LONG_WHITE = re.compile(f"[{WHITE}]{{5000,}}")
#: Distinct chunks of one generation; a worker keeps two, some 200 MB.
KEPT_CHUNKS = 500_000
#: Chunks above this many characters are encoded anew.
KEPT_CHARS = 64
#: Chunks that one call of the library encodes.
JOINED = 512
#: Characters of texts whose missing chunks are gathered.
HELD_CHARS = 1 << 20


class Encoder:
    """Texts to arrays of ids; ``encode`` gives the ids of strings as little-endian bytes, four an id.

    Chunks are kept in two generations: when the young one is full it becomes the old one, and chunks
    found there move on to the next, so that frequent chunks stay.  The missing chunks of all texts of a call are
    encoded together.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], whole: tuple[str, ...] = ()):
        self._encode, self._whole = encode, whole
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return self.ids_of([text])[0]

    def each(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of one text after another (a null is empty); few texts are held as chunks at once."""
        held, chars = [], 0
        for text in texts:
            held.append(text or "")
            chars += len(held[-1])
            if chars >= HELD_CHARS:
                yield from self.ids_of(held)
                held, chars = [], 0
        yield from self.ids_of(held)

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        open_texts, missing = [], set()
        for at, text in enumerate(texts):
            if any(w in text for w in self._whole):  # strings that the library treats apart
                out[at] = np.frombuffer(self._encode([text])[0], dtype="<u4")
                continue
            chunks = CHUNK.findall(text)
            parts = list(map(self._young.get, chunks))
            if None in parts:
                gaps = [i for i, part in enumerate(parts) if part is None]
                missing.update([chunks[i] for i in gaps])
                open_texts.append((at, chunks, parts, gaps))
            else:
                out[at] = np.frombuffer(b"".join(parts), dtype="<u4")
        found = self._added(missing) if missing else {}
        for at, chunks, parts, gaps in open_texts:
            for i in gaps:
                parts[i] = found[chunks[i]]
            out[at] = np.frombuffer(b"".join(parts), dtype="<u4")
        return out

    def _added(self, chunks: set[str]) -> dict[str, bytes]:
        old = self._old
        found = {c: old[c] for c in chunks if c in old}
        new = [c for c in chunks if c not in old]
        if new:
            found.update(zip(new, self._encode(new)))
        self._young.update(found if max(map(len, new), default=0) <= KEPT_CHARS else {c: x for c, x in found.items() if len(c) <= KEPT_CHARS})
        if len(self._young) > KEPT_CHUNKS:
            self._old, self._young = self._young, {}
        return found


@cache
def library_encoder(vocabulary: str) -> Encoder:
    """A tokenizer file of the ``tokenizers`` library, no special ids added."""
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(vocabulary)
    added = tokenizer.get_added_tokens_decoder()
    apart = next(((i, t.content) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word)), None)

    def listed(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(texts: list[str]) -> list[bytes]:
        if len(texts) == 1 or apart is None:
            return [ids.tobytes() for ids in listed(texts)]
        # one call for many chunks: the library encodes what is between special tokens by itself
        out = []
        for at in range(0, len(texts), JOINED):
            ids = listed([apart[1].join(texts[at : at + JOINED])])[0]
            data, cuts = ids.tobytes(), np.flatnonzero(ids == apart[0]).tolist()
            out += [data[4 * a : 4 * b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)])]
        return out

    return Encoder(encode, tuple(t.content for t in added.values()))


@cache
def rank_vocabulary(vocabulary: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(token): int(i) for token, i in map(bytes.split, lines)}


@cache
def rank_encoder(vocabulary: str) -> Callable[[str], np.ndarray]:
    """Text to ids by a rank file and the ``tiktoken`` library; no string counts as special."""
    import public_tokenizers
    import tiktoken

    ranks = rank_vocabulary(vocabulary)
    own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        ids, at = [], 0
        for run in LONG_WHITE.finditer(text):
            # the pattern takes such a run as one piece, less its last character if something follows; its own
            # look-ahead would step back over all of it on the stack
            end = run.end() - (run.end() < len(text))
            ids += own.encode_ordinary(text[at : run.start()])
            ids += own._encode_single_piece(run.group()[: end - run.start()])
            at = end
        ids += own.encode_ordinary(text[at:])
        return np.array(ids, dtype=np.uint32)

    return encode


@cache
def fallback_ids(vocabulary: str) -> np.ndarray:
    """By id: whether the token's bytes are no whole characters."""

    def partial(token: bytes) -> bool:
        try:
            token.decode()
        except UnicodeDecodeError:
            return True
        return False

    ranks = rank_vocabulary(vocabulary)
    out = np.zeros(max(ranks.values()) + 1, dtype=bool)
    out[[i for token, i in ranks.items() if partial(token)]] = True
    return out
