"""Budgeted context packs: ranked documents, the best window of each, folded into a budget of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions.chunks import chunk, chunks, truncate, truncated

CANDIDATES, CHARS, BUDGET = 50, 4, 4000


def terms(query: str) -> list[str]:
    return list(dict.fromkeys(t for w in query.lower().split() if len((t := w.strip(".,;:!?\"'()[]{}")).encode()) >= 2))


def window_score(text, words: list[str]):
    """One point a term that occurs, one more if it occurs again."""
    score, low = F.lit(0), F.lower(text)
    for t in words:
        n = F.length(low) - F.length(F.replace(low, F.lit(t)))
        score = score + (n > 0).cast("int") + (n > len(t)).cast("int")
    return score


def windows(docs: DataFrame, query: str, size: int) -> DataFrame:
    """path, seq, window, score of the best window of each text (path, text): most points, then the first.

    A text that fits is its own window, as it is; where no term occurs, the window is the text's beginning.  Both have seq 0
    and score 0 or that of the text.
    """
    words = terms(query)
    cut = docs.where(F.octet_length("text") > size).select("path", F.posexplode(chunks(size, size // 5)("text")).alias("seq", "window"))
    scored = cut.withColumn("score", window_score("window", words)).where("score > 0")
    best = scored.groupBy("path").agg(F.max(F.struct("score", (-F.col("seq")).alias("back"), "window")).alias("x"))
    head = F.when(F.octet_length("text") <= size, F.col("text")).otherwise(truncated(size)("text"))
    out = docs.where("text is not null").select("path", "text").join(best, "path", "left")
    hit = F.col("x").isNotNull()
    return out.select("path", F.when(hit, -F.col("x.back")).otherwise(0).alias("seq"), F.when(hit, truncated(size)("x.window")).otherwise(head).alias("window"), F.when(hit, F.col("x.score")).otherwise(window_score("text", words) if words else F.lit(0)).alias("score"))


def best_window(text: str, words: list[str], limit: int) -> str:
    """The window of at most limit bytes with most points; the text's beginning where it fits or no term occurs."""
    if len(text.encode()) <= limit or not words:
        return truncate(text, limit)
    best, most = "", 0
    for piece in chunk(text, limit, limit // 5):
        low = piece.lower()
        points = sum((t in low) + (low.count(t) > 1) for t in words)
        if points > most:
            best, most = piece, points
    return truncate(best or text, limit)


def pack(found: DataFrame, texts: DataFrame, query: str, budget: int = BUDGET, manifest: str = "") -> list[dict]:
    """Items (path, blob, score, content, manifest) of at most budget tokens; at most CANDIDATES rows come to the driver."""
    chars = (budget if budget > 0 else BUDGET) * CHARS
    each = chars // 3 if chars // 3 >= CHARS else chars
    top = found.orderBy("rank").limit(CANDIDATES).select("path", "score", "rank")
    # few rows are broadcast, so no text is shuffled
    rows = texts.select("path", "blob", "text").join(F.broadcast(top), "path").orderBy("rank").collect()
    out, used, words = [], 0, terms(query)
    for r in rows:
        if used >= chars:
            break
        if r["text"] is None:
            continue
        best = best_window(r["text"], words, min(each, chars - used))
        if best:
            out.append({"path": r["path"], "blob": r["blob"], "score": r["score"], "content": best, "manifest": manifest})
            used += len(best.encode())
    return out
