"""op 5: main text of web pages by two-pass block rules.

The page is read once, tag by tag, into blocks: text between block-level tags, with its length in words (two characters a word
in scripts without spaces), the share of characters inside links, the share of stop words, whether it stands in an article
container, in a list, and in which containers that name themselves as something else.

Pass one decides by densities: link-heavy blocks are bad, long ones with stop words are good, long ones without are bad; short
ones, and those between, stay open.  Stop words are those of ``STOP_WORDS``; where a page's long blocks together hold almost
none, its language counts as unknown and long blocks are good if they hold few links.  A page without any block of ``FEW_WORDS``
words is judged by its own: half of the longest is long there.

Elements that are never text (menus, footers, asides, what is hidden) are out.  Names are features that weigh against a container's
blocks.  A name counts whole (a role, class or id all of whose parts are boilerplate words or say where something stands:
share-bar, but not no-sidebar; a form), and only as long as the densities don't speak against it: a container that holds
``MOST`` of the page's good words is taken for what they say, unless an article stands beside it.  All other named blocks are
bad, and say nothing of their neighbours.  Then the good words are
counted inside and outside of article containers: if at least ``SHARE`` of them are inside, the article is where the text is,
blocks outside it are bad, and of those inside only link lists are (a paragraph of links, or one without stop words, is open again).
Otherwise containers decide nothing.

Pass two gives each open block the label of its nearest decided neighbours; where those differ, of the nearer one, and good if as
near.  Where densities find nothing good, long blocks of few links are; a page without any has no text.

Defined cases: null and empty pages give the empty text; unclosed and crossed tags, stray ``<`` and cut-off pages are read as far
as they go; repeated rows give equal results; an empty table gives an empty result.  Other columns than page_id, url and html are
not read.
"""

from __future__ import annotations

import html
import re
import string
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

#: Share of link characters from which a block is bad; words of a long block; shares of stop words from which a long block is
#: good, and under which it is bad.
LINKS, LONG, STOPS, FEW_STOPS = 0.5, 12, 0.12, 0.06
#: Share of stop words in all running text of a page under which its language counts as unknown; link share of a good block there.
UNKNOWN, FEW_LINKS = 0.03, 0.25
#: Share of a page's good words that must stand in article containers for these to count; share from which a name doesn't.
SHARE, MOST = 1 / 3, 3 / 4
#: A page whose blocks are all shorter than so many words is judged by its longest.
FEW_WORDS = 12
#: Frequent function words, by language.
STOP_WORDS = frozenset(
    " ".join(
        (
            "the of and to in is that it for was on are as with be at by this have from or an they which you not his her but had we there been has were",
            "de la le et les des en un une du que dans pour qui sur par est au avec pas ce il plus son sont se ne aux",
            "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei",
            "el los del las con para una por su al lo como mas pero sus sin sobre ser tiene",
            "di che è il per non una sono della con si le dei nel alla più come anche gli ha questo era",
            "o da em um para com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou",
            "het een van dat op te zijn voor met niet aan er om ook als dan maar bij uit nog naar",
            "i w z na do się nie że to jest o jak za po co ale przez od są tym dla czy był tylko oraz jego",
            "och att det som en på är av för med den till inte om har de ett var jag men så från vid kan",
            "og er til av som på det med for at en den ikke om har de et jeg var men så fra ved kan",
            "и в не на что с он как это по но она из за то все так его к у же вы от бы мы о был для или только",
            "і у в не на що з як це за але до та від його він вона про або також був",
            "ve bir bu da de için ile çok daha olarak gibi ne var ben o ama kadar sonra olan en",
            "a je v na se že s z do to o i ve jako by po které ale pro jsou od za byl tak není",
            "και το να του η της με που από για την είναι στο τα οι δεν σε τον ότι θα",
            "في من على أن إلى هذا التي الذي عن مع كان هذه لا ما هو قد بعد كل بين لم",
            "של את על לא זה עם הוא גם כי היא אני יש או אל כל היה מה אבל",
            "में है के की का को से और पर यह कि हैं ने भी एक था नहीं जो इस तो",
        )
    ).split()
)
#: Frequent function characters of scripts without spaces.
STOP_CHARACTERS = frozenset("的是了在有和不这他我们就也与而及の に は を が で と も た て".replace(" ", ""))
#: Elements that are never the text.  A form is a named container, since some wrap whole pages.
_DROP = frozenset("nav aside footer button select option textarea noscript template iframe svg canvas object audio video menu dialog head title label fieldset input header".split())
_RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul title option caption".split()
)
_LISTS = frozenset("ul ol dl menu dir".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NAMES = frozenset(
    "nav navbar navigation menu menubar topbar header masthead footer foot sidebar aside ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay"
    " share sharing social related recommended recommendations comment comments disqus respond reply replies discussion breadcrumb breadcrumbs pagination pager newsletter subscribe subscription signup login search searchbox widget toolbar copyright disclaimer contentinfo complementary".split()
)
#: What a boilerplate word may stand with in a name that still is one.
_PLACES = frozenset("site page main top bottom left right container wrapper wrap box bar list area section block group item items button buttons link links icon icons inner outer first last primary secondary global slot unit text form js".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[^\s_.:-]+")
_MARKS = string.punctuation + "«»„“”‘’…–—¿¡"
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Han, kana, Thai, Lao, Khmer and Burmese: written without spaces between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def _named(attributes: str) -> tuple[bool, bool]:
    """Whether class, id or role name boilerplate, and whether the element is hidden."""
    named = False
    if attributes and not attributes.isspace():
        for m in _NAMED.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return named, True
            if key == "style":
                if "display:none" in value.replace(" ", "").lower():
                    return named, True
            elif key != "aria-hidden":
                for name in value.split():
                    words = {w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", name))}
                    named = named or not words.isdisjoint(_NAMES) and words <= _NAMES | _PLACES
    return named, False


class Piece(NamedTuple):
    """A block: its text, share of link characters, numbers of the named containers around it, and where it stands."""

    text: str
    links: float
    names: tuple[int, ...]
    article: bool
    listed: bool
    hidden: bool


def blocks_of(page: str) -> list[Piece]:
    out: list[Piece] = []
    stack: list[tuple[str, int, bool, bool]] = []  # tag, number of a named container or -1, article, hidden
    parts: list[str] = []
    open_names: list[int] = []
    linked, in_link, containers, at, articles, lists, hides = 0, 0, 0, 0, 0, 0, 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(raw)
            if in_link:
                linked += len(raw)

    def flush() -> None:
        nonlocal linked
        if parts:
            clean = " ".join(html.unescape("".join(parts)).split())
            if clean:
                out.append(Piece(clean, min(1.0, linked / max(1, sum(map(len, parts)))), tuple(open_names), articles > 0, lists > 0, hides > 0))
            parts.clear()
        linked = 0

    def close(i: int) -> None:
        """Takes the elements from i on off the stack."""
        nonlocal articles, lists, hides
        for tag, name, article, hidden in stack[i:]:
            articles, lists, hides = articles - article, lists - (tag in _LISTS), hides - hidden
            if name >= 0:
                open_names.pop()
        del stack[i:]

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        if tag == "br":
            text(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
        if not closing and tag in _RAW and not (m[3] or "").rstrip().endswith("/"):
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            if tag in _BLOCK:
                flush()
            at = end.end() if end else size
            continue
        if tag in _BLOCK:
            flush()
            in_link = 0 if tag != "a" and closing else in_link
        if tag in _VOID or tag == "a":
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in _BLOCK and tag not in _DROP and any(x[0] in _BLOCK for x in stack[i + 1 :]):
                        break  # an inline end tag doesn't close blocks
                    if tag not in _BLOCK and tag in _DROP:
                        flush()
                    close(i)
                    break
            continue
        if tag == "p":
            for i in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in _BLOCK:
                    break
        is_article = tag in ("article", "main") or 'role="main"' in (m[3] or "") or 'itemprop="articleBody"' in (m[3] or "")
        named, hidden = _named(m[3] or "")
        named = tag not in ("html", "body") and (named or tag == "form")
        hidden = hidden or tag in _DROP and not (tag == "header" and articles)
        if (named or hidden) and tag not in _BLOCK:
            flush()
        stack.append((tag, containers if named else -1, is_article, hidden))
        if named:
            open_names.append(containers)
        containers, articles, lists, hides = containers + named, articles + is_article, lists + (tag in _LISTS), hides + hidden
    flush()
    return out


def _measure(text: str) -> tuple[float, float]:
    """Words and stop words of a block."""
    words = text.lower().split()
    n, stops = len(words), sum(w.strip(_MARKS) in STOP_WORDS for w in words)
    if unspaced := _UNSPACED.findall(text):
        # a run without spaces counts two characters a word, a function character one stop word
        n = max(n, len(unspaced) / 2 + sum(not _UNSPACED.search(w) for w in words))
        stops += sum(c in STOP_CHARACTERS for c in unspaced)
    return n, stops


def _running(blocks: list[Piece], size: list[tuple[float, float]], some: list[int]) -> list[int]:
    """The long blocks of some, but for link-heavy ones."""
    free = [i for i in some if blocks[i].links < LINKS]
    longest = max((size[i][0] for i in free), default=0)
    least = max(1, longest / 2) if longest < FEW_WORDS else LONG
    return [i for i in free if size[i][0] >= least]


def _dense(blocks: list[Piece], size: list[tuple[float, float]], running: list[int], judged: list[int]) -> dict[int, bool | None]:
    """Good, bad or open of the running blocks, by stop words; where judged hold almost none, by links."""
    unknown = sum(size[i][1] for i in judged) < UNKNOWN * sum(size[i][0] for i in judged)
    out: dict[int, bool | None] = {}
    for i in running:
        n, stops = size[i]
        good = blocks[i].links < FEW_LINKS if unknown else stops >= STOPS * n
        out[i] = True if good else False if unknown or stops < FEW_STOPS * n else None
    return out


def _out(blocks: list[Piece], size: list[tuple[float, float]]) -> list[bool]:
    """Blocks that are hidden or in a container whose name counts."""
    shown = [i for i, b in enumerate(blocks) if not b.hidden]
    running = _running(blocks, size, shown)
    plain = [i for i in running if not blocks[i].names]
    good = [i for i, x in _dense(blocks, size, running, plain or running).items() if x]
    words, inside = sum(size[i][0] for i in good), dict.fromkeys((c for b in blocks for c in b.names), 0.0)
    for i in good:
        for c in blocks[i].names:
            inside[c] += size[i][0]
    beside = any(blocks[i].article and not blocks[i].names and blocks[i].links < LINKS for i in shown)
    counts = {c for c, n in inside.items() if beside or not words or n < MOST * words}
    return [b.hidden or not counts.isdisjoint(b.names) for b in blocks]


def _labels(blocks: list[Piece]) -> tuple[list[bool | None], list[bool]]:
    """Pass one: good, bad or open; and which blocks names or hiding take out."""
    size = [_measure(b.text) for b in blocks]
    out = _out(blocks, size)
    running = _running(blocks, size, [i for i, x in enumerate(out) if not x])
    labels: list[bool | None] = [None if not x and b.links < LINKS else False for b, x in zip(blocks, out, strict=True)]
    dense = _dense(blocks, size, running, running)
    if True not in dense.values():
        dense |= {i: True for i in running if blocks[i].links < FEW_LINKS}
    for i, x in dense.items():
        labels[i] = x
    words = [sum(size[i][0] for i in running if labels[i] and blocks[i].article == inside) for inside in (False, True)]
    if words[1] > 0 and words[1] >= SHARE * sum(words):
        for i, b in enumerate(blocks):
            if not out[i] and not labels[i]:
                labels[i] = False if not b.article or b.listed and b.links >= LINKS else None
            elif not b.article:
                labels[i] = False
    return labels, out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    labels, out = _labels(blocks)
    if True not in labels:
        return ""
    # inside an article that counts, only its own blocks are neighbours
    scope = all(b.article for b, label in zip(blocks, labels, strict=True) if label)
    decided = [i for i, x in enumerate(labels) if x is not None and not out[i] and (x or not scope or blocks[i].article)]
    kept, j = [], 0
    for i, label in enumerate(labels):
        while j < len(decided) and decided[j] < i:
            j += 1
        if label is None:
            before, after = decided[j - 1] if j else None, decided[j] if j < len(decided) else None
            if before is None or after is None:
                label = labels[after if before is None else before]
            else:
                label = labels[before] if i - before < after - i else labels[after] if after - i < i - before else labels[before] or labels[after]
        if label:
            kept.append(blocks[i].text)
    return " ".join(kept)


def _extract(batches):
    for batch in batches:
        texts = [main_text(batch.column("html")[i].as_py()) for i in range(len(batch))]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html); no shuffle."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
