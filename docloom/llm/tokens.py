"""Token ids of whole texts by a public tokenizer file, with its answers for words remembered."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

END_ID = 2


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Fixed values of the vocabulary file for which a text may be encoded run by run; for any other file texts go whole.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


def _places(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each begin, as many as its size, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(begins - before, sizes) + np.arange(int(sizes.sum()))


class WordTokens:
    """Ids of texts.

    The file's pre-tokenizer drops white space and never joins across it, so the library encodes each run between
    blanks alone and gives the ids of the whole text. The pre-tokenizer also parts letters from signs: a run of signs,
    Latin-1 letters and signs is the ids of its three parts, and the letters, which NFC leaves alone, are lower-cased.
    Signs that could begin a contraction or a special token don't count as such; all other runs are one part. The ids of
    parts are remembered in a table of bounded size. Unknown letters go many at a time, parted by blanks, to the library's
    model without the file's normalizer (the last id of a word ends with WORD_END), other parts to the whole tokenizer.
    """

    LIMIT = 600_000
    LONG = 64
    TOGETHER = 500
    SIGNS = r"[!-&(-/:;=?@\[-`{}~]*"
    PARTS = rf"^(?P<before>{SIGNS})(?P<letters>[A-Za-zªµºÀ-ÖØ-öø-ÿ]+)(?P<after>{SIGNS})$"

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            file = json.load(f)
        kinds = [n["type"] for n in (file["normalizer"] or {}).get("normalizers", [])]
        splits = [p["pattern"].get("Regex") for p in (file["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        self.by_run = kinds == NORMALIZERS and splits == [SPLIT] and file["model"].get("end_of_word_suffix") == WORD_END
        self._forget()
        if self.by_run:
            self.words = Tokenizer.from_file(path)
            self.words.normalizer = None
            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), level])
            vocabulary = self.words.get_vocab()
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def _forget(self) -> None:
        """Part k has the ids from bounds[k] up to bounds[k + 1]; the empty part has none."""
        self.known, self.ids, self.bounds = {"": 0}, np.empty(0, dtype="<u4"), np.zeros(2, dtype=np.int64)

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, and how many each has, by the whole tokenizer."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype="<u4", count=int(sizes.sum())), sizes

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of lower-case words of letters."""
        joined = [" ".join(words[i : i + self.TOGETHER]) for i in range(0, len(words), self.TOGETHER)]
        ids = np.concatenate([np.empty(0, "<u4"), *(np.asarray(e.ids, dtype="<u4") for e in self.words.encode_batch_fast(joined, add_special_tokens=False))])
        sizes = np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)
        if len(sizes) != len(words) or int(sizes.sum()) != len(ids):
            raise ValueError("ids of words that don't end with them")
        return ids, sizes

    def _parts(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each distinct run's three parts begin and how many they are (a row a run), and all ids."""
        split = pc.extract_regex(runs, self.PARTS)
        whole = pc.or_(pc.is_null(split), pc.greater(pc.utf8_length(runs), self.LONG))
        before, letters, after = (pc.if_else(whole, "", pc.struct_field(split, k)) for k in range(3))
        coded = pa.concat_arrays([before, pc.if_else(whole, runs, pc.utf8_lower(letters)), after]).dictionary_encode()
        parts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
        if len(self.known) > self.LIMIT:
            self._forget()
        number = np.fromiter(map(self.known.get, parts, repeat(-1)), dtype=np.int64, count=len(parts))
        ids, bounds = self.ids, self.bounds
        gaps = np.flatnonzero(number < 0).tolist()
        if gaps:
            words, short, long = [], [], []
            for k in gaps:
                part = parts[k]
                if len(part) > self.LONG:
                    long.append(k)
                else:  # letters of a short run are in lower case already
                    (words if part.isalpha() and (part.isascii() or max(part) <= "\xff") else short).append(k)
            found = [f([parts[k] for k in some]) for f, some in ((self._encode_words, words), (self._encode, short), (self._encode, long)) if some]
            first = len(bounds) - 1
            number[[*words, *short, *long]] = np.arange(first, first + len(gaps))
            ids = np.concatenate([ids, *(i for i, _ in found)])
            bounds = np.concatenate([bounds, bounds[-1] + np.cumsum(np.concatenate([n for _, n in found]))])
            kept = first + len(words) + len(short)  # long parts are not remembered
            self.known.update(zip((parts[k] for k in chain(words, short)), range(first, kept), strict=True))
            self.ids, self.bounds = ids[: bounds[kept]], bounds[: kept + 1]
        codes = number[coded.indices.to_numpy()].reshape(3, -1).T
        return bounds[codes], bounds[codes + 1] - bounds[codes], ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and how many each text has. A null text has none.

        Each distinct run of a batch is parted once and each distinct part looked up once; the rest is Arrow and numpy."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_run:
            return self._encode(texts.to_pylist())
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        begins, sizes, ids = self._parts(coded.dictionary)
        of_runs = ids[_places(begins.ravel(), sizes.ravel())]
        sizes = sizes.sum(axis=1)
        codes = coded.indices.to_numpy()
        n = sizes[codes]
        before = np.concatenate([[0], np.cumsum(n)])
        bounds = before[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return of_runs[_places((np.cumsum(sizes) - sizes)[codes], n)], np.diff(bounds)

    def stream(self, texts: Iterable[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts with the end id after each, and the lengths of the texts with it."""
        found = [self.encode(t) for t in texts]
        if not found:
            return np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64)
        lengths = np.concatenate([c for _, c in found]) + 1
        ids = np.full(int(lengths.sum()), END_ID, dtype="<u4")
        own = np.ones(len(ids), dtype=bool)
        own[np.cumsum(lengths) - 1] = False
        ids[own] = np.concatenate([i for i, _ in found])
        return ids, lengths


_LOADED: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The worker process's own instance, so that tasks share what it remembers."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


@lru_cache(maxsize=4)
def sentence_ends(path: str) -> np.ndarray:
    """For each token id, whether its string ends a sentence (. ! ? at a word's end)."""
    with open(path) as f:
        vocabulary = json.load(f)["model"]["vocab"]
    ends = np.zeros(max(vocabulary.values()) + 16, dtype=bool)
    for token, number in vocabulary.items():
        ends[number] = token.removesuffix("</w>").endswith((".", "!", "?")) and token.endswith("</w>")
    return ends
