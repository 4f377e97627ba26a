"""Public vocabularies, read once per process: their encoders and the bytes of their tokens."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Files of public tokenizers, both parameters of the operators that use them.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: the pattern by which byte-level vocabularies split texts before any merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself where it prints, else the next free one
    from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """token_bytes[id] are a token's bytes, sizes[id] their number."""

    token_bytes: list[bytes]

    @property
    def size(self) -> int:
        return len(self.token_bytes)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raise NotImplementedError

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


class ByteLevel(Vocabulary):
    """A byte-level BPE file of the `tokenizers` library whose merges stand in the order of their ids.

    With that order the ids are merge ranks, so tiktoken gives the same ids some four times as fast; a test holds them
    against the library's. With special=True the strings of special tokens become these tokens, as in the library by
    default; otherwise they are plain text.
    """

    def __init__(self, path: str, special: bool = False) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        of, vocab = _byte_signs(), data["model"]["vocab"]
        added = {t["content"]: t["id"] for t in data["added_tokens"] if t["special"]}
        ranks = {bytes(of[c] for c in s): i for s, i in vocab.items() if s not in added}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        if [vocab[a + b] for a, b in merges] != list(range(256, 256 + len(merges))):
            raise ValueError(f"{path}: merges do not stand in the order of their ids")
        self.special = added if special else {}
        self.encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.token_bytes = [b""] * (max([*ranks.values(), *added.values()]) + 1)
        for b, i in [*ranks.items(), *((s.encode(), i) for s, i in added.items())]:
            self.token_bytes[i] = b
        self.sizes = np.array([len(b) for b in self.token_bytes], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        allowed = set(self.special)
        return [np.array(self.encoding.encode(t, allowed_special=allowed) if any(s in t for s in allowed) else self.encoding.encode_ordinary(t), np.uint32) for t in texts]


class Pieces(Vocabulary):
    """A SentencePiece model. A piece's bytes are its UTF-8 with U+2581 as a space; a byte piece is its byte."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.sp.IdToPiece(i) for i in range(self.sp.GetPieceSize())]
        self.token_bytes = [bytes([int(p[3:5], 16)]) if self.sp.IsByte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.sizes = np.array([len(b) for b in self.token_bytes], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self.sp.encode(texts, num_threads=1)]


#: A special token that stands for nothing: without any, tiktoken looks for the empty one at every sign.
NONE = "<|none|>"


class MergedPieces:
    """The ids of a SentencePiece BPE model by tiktoken, in about half the time.

    Both join, of all neighbours that make a piece, those of the best score, the first of equals. tiktoken joins bytes,
    so signs come first: each is put together from its bytes, and what is left of one that is no piece becomes byte
    pieces. No piece holds a space after another sign, so words can be cut apart beforehand. Pieces of spaces alone have
    one score, which ranks can't tell: texts with two spaces together (or one at the front, where the model adds its own)
    are left to the library, and so are all if the model is of another kind.
    """

    def __init__(self, sp) -> None:
        self.sp, self.encoding = sp, None
        ids = [i for i in range(sp.GetPieceSize()) if not (sp.IsByte(i) or sp.IsControl(i) or sp.IsUnknown(i))]
        pieces = {i: sp.IdToPiece(i) for i in ids}
        of_byte = {int(sp.IdToPiece(i)[3:5], 16): i for i in range(sp.GetPieceSize()) if sp.IsByte(i)}
        joined = sorted((i for i in ids if len(pieces[i]) > 1 and pieces[i].strip("▁")), key=lambda i: -sp.GetScore(i))
        if len(of_byte) < 256 or not self._known(sp) or any("▁" in pieces[i].lstrip("▁") for i in joined) or len({sp.GetScore(i) for i in joined}) < len(joined):
            return
        import tiktoken

        signs = {pieces[i].replace("▁", " ").encode(): i for i in ids if len(pieces[i]) == 1}
        # What each rank stands for: bytes, beginnings of signs and signs, then the joined pieces, best score first.
        parts = {bytes([b]): [signs.get(bytes([b]), of_byte[b])] for b in range(256)}
        for c in signs:
            for k in range(2, len(c) + 1):
                parts.setdefault(c[:k], [signs[c]] if k == len(c) else [of_byte[b] for b in c[:k]])
        parts |= {pieces[i].replace("▁", " ").encode(): [i] for i in joined}
        self.encoding = tiktoken.Encoding("pieces", pat_str=" ?[^ ]+| ", mergeable_ranks={b: n for n, b in enumerate(parts)}, special_tokens={NONE: len(parts)})
        self.sizes = np.array([len(x) for x in parts.values()])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.array([i for x in parts.values() for i in x], np.int32)

    @staticmethod
    def _known(sp) -> bool:
        """Whether the model merges pairs, has plain pieces only, and changes nothing in a text but its spaces."""
        try:
            from sentencepiece import sentencepiece_model_pb2 as proto
        except ImportError:
            return False
        model = proto.ModelProto.FromString(sp.serialized_model_proto())
        kinds, t, n = proto.ModelProto.SentencePiece, model.trainer_spec, model.normalizer_spec
        plain = {kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE} >= {x.type for x in model.pieces}
        as_is = n.add_dummy_prefix and n.escape_whitespaces and not (n.precompiled_charsmap or n.remove_extra_whitespaces)
        return plain and as_is and t.model_type == t.BPE and t.byte_fallback and not t.treat_whitespace_as_suffix

    def encode(self, text: str) -> np.ndarray:
        spaced = f" {text}".replace("▁", " ")
        if not self.encoding or not text or "  " in spaced:
            return np.array(self.sp.encode(text), np.int32)
        ranks = self.encoding.encode_to_numpy(spaced, disallowed_special=())
        n = self.sizes[ranks]
        if len(ranks) == n.sum():
            return self.flat[self.starts[ranks]]
        return self.flat[np.repeat(self.starts[ranks] - np.cumsum(n) + n, n) + np.arange(n.sum())]


@lru_cache(maxsize=4)
def byte_level(path: str = BYTE_BPE, special: bool = False) -> ByteLevel:
    return ByteLevel(path, special)


@lru_cache(maxsize=4)
def pieces(path: str = PIECE_BPE) -> Pieces:
    return Pieces(path)
