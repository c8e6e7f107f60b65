"""Plain Python versions of the operators' results, one document after the other."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import public_tokenizers


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def near_groups(docs, size=3, percent=85):
    """{doc_id: (n_shingles, component_id)}; every pair is compared."""
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        sets[i] = frozenset(zip(*(w[k:] for k in range(size)))) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by_shingle[x].append(i)
    both = Counter()
    for ids in by_shingle.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                both[a, b] += 1
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@cache
def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def token_ids(text):
    return [*_tokenizer().encode(text or "", add_special_tokens=False).ids, 2]


def pieces(text):
    ids = token_ids(text)
    return ids, lambda start, length: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[start : start + length]))


def matches(text, items, window=10):
    """(n_words, n_hit, item ids)"""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        n = min(window, len(iw))
        own = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
        for k in range(len(w) - n + 1) if n else ():
            if tuple(w[k : k + n]) in own:
                hit |= set(range(k, k + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def base_spans(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    text = text or ""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    w = word.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if word.search(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for k in range(len(w) - 4):
        at[tuple(w[k : k + 5])].append(k)
    repeated = {j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def warc_rows(pages):
    first = {}
    for i, html in sorted(pages):
        first.setdefault(html or "", i)
    out = {}
    for i, html in pages:
        b = (html or "").encode()
        f = first[html or ""]
        out[i] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if f == i else "revisit", None if f == i else f)
    return out


@cache
def _pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def n_tokens(text):
    return len(_pieces().encode(text or ""))
