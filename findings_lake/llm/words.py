"""Worker-side helpers around tokenizer files: per-word token ids and
lengths with bounded caches. Texts are cut only where the tokenizer itself
cuts, so cached results equal those of the library on whole texts."""

from __future__ import annotations

import json
import unicodedata

#: Added to a text's count when a chunk can't be counted on its own.
WHOLE = 1 << 40
#: Chunks longer than this are encoded but never cached.
LONGEST = 64


class ChunkLengths(dict):
    """Chunk between two spaces -> number of tokens of ``" " + chunk``.

    A byte-level tokenizer glues one space to the word behind it, so a text
    cut before each single space gives the same tokens as the whole text, as
    long as the chunk starts with a visible character and holds no added
    (special) token. Other chunks give ``WHOLE``: the caller then encodes the
    whole text with the library.
    """

    def __init__(self, path: str, frequent: dict[str, int], limit: int):
        from tokenizers import Tokenizer

        super().__init__(frequent)
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.frequent, self.limit = frequent, limit
        self.heads: dict[str, int] = {}

    def encoded(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def __missing__(self, chunk: str) -> int:
        if not chunk or unicodedata.category(chunk[0])[0] not in "LNPSM" or any(a in chunk for a in self.added):
            n = WHOLE
        else:
            n = self.encoded(" " + chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.frequent)
            self[chunk] = n
        return n

    def head(self, chunk: str) -> int:
        if any(a in chunk for a in self.added):
            return WHOLE
        n = self.heads.get(chunk)
        if n is None:
            n = self.encoded(chunk)
            if len(chunk) <= LONGEST and len(self.heads) < self.limit:
                self.heads[chunk] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        chunks = text.split(" ")
        n = self.head(chunks[0])
        chunks[0] = None
        n += sum(map(self.__getitem__, chunks[1:]))
        return n if n < WHOLE else self.encoded(text)


def chunk_lengths(path: str, chunks: list[str]) -> list[int]:
    """Lengths of ``chunks`` as ``ChunkLengths`` gives them (driver side)."""
    cache = ChunkLengths(path, {}, len(chunks) + 1)
    return [cache[c] for c in chunks]


def _byte_letters() -> dict[str, int]:
    """The usual printable stand-ins of bytes in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class WordIds(dict):
    """White-space separated chunk (UTF-8 bytes) -> its token ids as
    little-endian unsigned 32-bit bytes, for a BPE file whose words carry an
    end mark and whose pre-tokenizer drops white space.

    Chunks of plain Latin letters, digits and punctuation are merged in bulk
    by ``tiktoken`` over the file's own merges (a zero byte stands for the end
    mark); every other chunk is encoded by ``tokenizers`` itself. Lower case,
    normal form and splits never reach across white space, so chunks may be
    encoded one by one. The cache is emptied when it holds ``limit`` chunks.
    """

    def __init__(self, path: str, limit: int = 600_000):
        import numpy as np
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.limit = limit
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end, byte = model["vocab"], model["end_of_word_suffix"], _byte_letters()
        letter = {b: c for c, b in byte.items()}

        def raw(token: str) -> bytes:
            last = token.endswith(end)
            return bytes(byte[c] for c in (token[: -len(end)] if last else token)) + b"\0" * last

        ranks = {bytes([b]): b for b in range(256)}
        ids = [vocab[letter[b]] for b in range(256)]
        for token in [letter[b] + end for b in range(1, 256)] + ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]:
            if ranks.setdefault(raw(token), len(ids)) == len(ids):
                ids.append(vocab[token])
        self.bulk = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.ids = np.array(ids, dtype="<u4")
        self.ends = np.zeros(len(ids), dtype=bool)
        self.ends[[r for b, r in ranks.items() if b.endswith(b"\0")]] = True
        self.plain = regex.compile(r"[!-~¡-įı-ɏ]+")
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def learn(self, chunks: list[bytes]) -> None:
        """Put the ids of ``chunks`` (none of them known) into the cache."""
        import numpy as np

        if len(self) + len(chunks) > self.limit:
            self.clear()
        plain, words, counts = [], [], []
        for chunk in chunks:
            text = chunk.decode()
            if self.plain.fullmatch(text) and not any(a in text for a in self.added):
                parts = self.parts.findall(text.lower())
                plain.append(chunk)
                words += parts
                counts.append(len(parts))
            else:
                self[chunk] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if plain:
            ranks = np.array(self.bulk.encode_ordinary("\0".join(words) + "\0"))
            stops = (np.flatnonzero(self.ends[ranks]) + 1)[np.cumsum(counts) - 1]
            data, at = self.ids[ranks].tobytes(), 0
            for chunk, stop in zip(plain, (stops * 4).tolist()):
                self[chunk] = data[at:stop]
                at = stop

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of every text, as bytes."""
        split = [t.split() for t in texts]
        fresh = set().union(*split).difference(self)
        if len(self) + len(fresh) > self.limit:
            self.clear()
            fresh = set().union(*split)
        if fresh:
            self.learn(sorted(fresh))
        return [b"".join(map(self.__getitem__, words)) for words in split]
