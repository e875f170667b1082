"""Plain-Python versions of the retrieval operators, for small fixtures only."""

import hashlib
import math
import re

from evalspark.functions.text import STOPWORDS


def words(text, stopwords=True):
    found = [w.replace(",", "") for w in re.findall(r"[a-z]+|\d+(?:,\d{3}\b)*(?:\.\d+(?:,\d{3}\b)*)?", text.lower())]
    return [w for w in found if not (stopwords and w in STOPWORDS)]


def scores(question, texts, k1=1.2, b=0.75, stopwords=True, stem=None, corpus=None):
    stem = stem or (lambda w: w)
    cut = lambda t: [stem(w) for w in words(t, stopwords)]
    docs = [cut(t) for t in texts]
    base = docs if corpus is None else [cut(t) for t in corpus]
    avgdl = sum(map(len, docs)) / len(docs) or 1.0
    out = [0.0] * len(docs)
    for term in sorted(set(cut(question))):
        df = sum(term in d for d in base)
        weight = math.log(1 + (len(base) - df + 0.5) / (df + 0.5))
        for i, d in enumerate(docs):
            tf = d.count(term)
            if tf:
                out[i] += weight * tf / (tf + k1 * (1 - b + b * len(d) / avgdl))
    return out


def ranking(scored):
    return sorted(scored, key=lambda u: (-round(scored[u], 9), hashlib.sha1(u.encode()).hexdigest()))


def metrics(ranks):
    """From the ranking as a vector of zeros and ones, best place first."""
    relevant = [int(place in ranks) for place in range(1, max(ranks) + 11)]
    best = sorted(relevant, reverse=True)
    out = {"rr": 1 / (1 + relevant.index(1))}
    for k in (1, 3, 5, 10):
        found = sum(relevant[:k])
        gained, possible = (math.fsum(hit * math.log(2) / math.log(2 + i) for i, hit in enumerate(v[:k])) for v in (relevant, best))
        out |= {f"recall_at_{k}": found / sum(relevant), f"all_gold_at_{k}": float(found == sum(relevant)), f"ndcg_at_{k}": gained / possible}
    return out
