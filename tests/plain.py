"""Plain-Python expectations, for tests only."""

import re
import unicodedata


def category(c):
    return unicodedata.category(c)


def clean(text):
    kept = (c for c in text if c in "\t\n\r" or not (category(c)[0] == "C" or c == "�"))
    return "".join(" " if c in "\t\n\r" or category(c) == "Zs" else c for c in kept)


def is_cjk(c):
    p = ord(c)
    return any(
        a <= p <= b
        for a, b in [
            (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F),
            (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F),
        ]
    )


def is_punct(c):
    return (c.isascii() and c.isprintable() and not c.isalnum() and c != " ") or category(c)[0] == "P"


def fold(word):
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if category(c) != "Mn")


def cut(word):
    return "".join(f"\x00{c}\x00" if is_punct(c) else c for c in word).replace("\x00", " ").split()


def basic_tokens(text, lower=True):
    guarded = {"[UNK]", "[SEP]", "[PAD]", "[CLS]", "[MASK]"}
    spaced = "".join(f" {c} " if is_cjk(c) else c for c in clean(text))
    out = []
    for w in spaced.split():
        out += [w] if w in guarded else cut(fold(w) if lower else w)
    return out


def normalize(text, lower=False):
    t = unicodedata.normalize("NFC", text)
    t = t.lower() if lower else t
    t = re.sub(r"([.!?])", r" \1", t)
    return re.sub(r"[^a-zA-Z0-9.!?]+", " ", t)


def standardize(text):
    for a, b in [("—", "-"), ("–", "-"), ("―", "-"), ("…", "..."), ("´", "'")]:
        text = text.replace(a, b)
    signs = "-~!\";?+,)(\\/*[]}{|_"
    text = re.sub("|".join(re.escape(s) + "+" for s in signs), lambda m: f" {m.group()} ", text)
    text = re.sub(r"\s*\n\s*", " \n ", text)
    return re.sub(r"[^\S\n]+", " ", text).strip()


def wordpiece(word, vocab):
    if len(word) > 100:
        return ["[UNK]"]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocab:
                break
        else:
            return ["[UNK]"]
        out.append(piece)
        at = end
    return out


def bpe(word, ranks):
    parts = list(word[:-1]) + [word[-1] + "</w>"]
    while len(parts) > 1:
        ranked = [(ranks[p], p) for p in zip(parts, parts[1:]) if p in ranks]
        if not ranked:
            break
        left, right = min(ranked)[1]
        merged, at = [], 0
        while at < len(parts):
            hit = parts[at] == left and at + 1 < len(parts) and parts[at + 1] == right
            merged.append(left + right if hit else parts[at])
            at += 2 if hit else 1
        parts = merged
    return parts


def truncate(la, lb, m):
    while la + lb > m:
        if la > lb:
            la -= 1
        else:
            lb -= 1
    return la, lb


def auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def pack(sentences, bptt):
    pairs = [(a, b) for s in sentences for a, b in zip(s, s[1:])]
    whole = len(pairs) // bptt
    return [pairs[i * bptt : (i + 1) * bptt] for i in range(whole)]
