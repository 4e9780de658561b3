"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Blocks inside navigation, headers and footers of the page,
sidebars, forms, notices, adverts and reader comments are removed by their markup. All others are classified twice: the first pass
decides by length, link density and stop-word density; headings, short blocks and others that it leaves open then inherit
the label of their nearest decided neighbours, on both sides. Blocks of an article element have each other as
neighbours, and what stands outside of one is text only between two blocks that are. Within an article a long block of
links is boilerplate as well, but few stop words only leave a block open: no list of words covers every language.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags, names of page parts, and frequent words of several languages.
_BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
_SKIPPED_TAGS = frozenset("script style noscript template textarea svg math iframe object canvas audio video button select option datalist head title".split())
_RAW_TAGS = frozenset("script style textarea title noscript iframe xmp".split())
_VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_PART_TAGS = frozenset("nav aside form footer menu dialog fieldset search".split())
_BODY_TAGS = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 dt".split())
_PART_NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|popup|modal|newsletter|subscri\w*|signup|login|nav\w*|menu\w*|breadcrumb\w*|sidebar|side-bar|widget\w*|foot(?:er)?|masthead|top-?bar|site-header|page-header|comments?|comment-\w+|respond|replies|disqus|related|recommend\w*|share|sharing|social|toolbar|tags|pagination|pager|copyright|skip-link)(?:$|[^a-z])"
)
_PART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_BODY_NAMES = re.compile(r"(?:^|[^a-z])(?:article-?body|post-?(?:content|body)|entry-?content|story-?body|main-?content|articlebody)(?:$|[^a-z])")
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so what up its about into than them can only other "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen zum war "
    "le la les du et un une est que qui dans pour pas par sur au avec il elle ne se plus ce son sa ses ou mais nous vous leur cette aux comme "
    "el los las y por con no su para del lo más pero sus o este sí porque esta entre cuando muy sin sobre también hay todo".split()
)

#: Thresholds of the first pass, in characters and shares of words.
SHORT, LONG, MAX_LINKS, LOW_STOPS, HIGH_STOPS = 70, 200, 0.4, 0.06, 0.22

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")


class _Block:
    __slots__ = ("parts", "links", "kind", "inside", "text")

    def __init__(self, kind: str, inside: str):
        self.parts, self.links, self.kind, self.inside = [], 0, kind, inside


def _part_of(tag: str, attributes: str, inside: str) -> str:
    """Where an element's content stands: "out" (skipped), "part" (boilerplate), "body" (article) or "" (unknown)."""
    if tag in _SKIPPED_TAGS or inside == "out":
        return "out"
    if inside == "part" or tag in _PART_TAGS or (tag == "header" and inside != "body"):
        return "part"
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)} if "=" in attributes or "hidden" in attributes else {}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return "out"
    names = f"{found.get('class', '')} {found.get('id', '')}"
    if tag in _BODY_TAGS or found.get("role") in ("main", "article") or found.get("itemprop") == "articlebody" or _BODY_NAMES.search(names):
        # an article within reader comments, handled above, stays a part
        return "part" if tag == "article" and re.search(r"comment|teaser|related|promo", names) else "body"
    if found.get("role") in _PART_ROLES or (tag not in ("html", "body") and names.strip() and _PART_NAMES.search(names)):
        return "part"
    return inside


def blocks(page: str) -> list[_Block]:
    """The blocks of a page in order, with white space and character references resolved. Tolerates any markup."""
    out: list[_Block] = []
    stack: list[tuple[str, str]] = []
    opened: Counter[str] = Counter()  # open tags of the stack, so that a stray closing tag costs nothing
    inside, kind, links, at = "", "", 0, 0
    current = _Block("", "")

    def close() -> None:
        nonlocal current
        if current.parts:
            out.append(current)
        current = _Block(kind, inside)

    def write(text: str) -> None:
        if inside != "out" and text:
            current.parts.append(text)
            if links:
                current.links += len(text.strip())

    def push(tag: str, before: str) -> None:
        stack.append((tag, before))
        opened[tag] += 1

    raw = None
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        write(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in _BLOCK_TAGS or opened[tag]:
                i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None) if opened[tag] else None
                if i is not None and (tag in _BLOCK_TAGS or stack[i][1] != inside or tag in _SKIPPED_TAGS):
                    inside = stack[i][1]
                    opened.subtract(t for t, _ in stack[i:])
                    del stack[i:]
                if tag in _BLOCK_TAGS:
                    kind, links = "", 0
                    close()
            continue
        if tag == "br":
            write(" ")
            continue
        if tag in _VOID_TAGS:
            if tag == "hr":
                close()
            continue
        before = inside
        if tag in _BLOCK_TAGS:
            if stack and stack[-1][0] in _CLOSED_BY_BLOCK:
                opened[stack[-1][0]] -= 1
                before = stack.pop()[1]
            inside, kind, links = _part_of(tag, m[3], before), tag, 0
            close()
            push(tag, before)
        else:
            inside = _part_of(tag, m[3], before)
            if tag == "a":
                links += 1
            if inside != before or tag in _SKIPPED_TAGS:
                close()
                push(tag, before)
        if tag in _RAW_TAGS and (raw := re.compile(rf"</{re.escape(tag)}\b", re.IGNORECASE).search(page, at)):
            at = raw.start()
        elif tag in _RAW_TAGS:
            at = len(page)
    write(page[at:])
    close()
    done = []
    for b in out:
        b.text = _SPACE.sub(" ", html.unescape("".join(b.parts))).strip()
        if b.text:
            done.append(b)
    return done


def _first_pass(b: _Block, has_body: bool) -> str:
    """good, bad, near (open, leaning to good) or short (open)."""
    if b.inside == "part":
        return "bad"
    words = [w.lower() for w in _WORD.findall(b.text)]
    links, n = b.links / max(1, len(b.text)), len(b.text)
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if b.inside == "body":
        if n < SHORT:
            return "short"
        return "bad" if links > MAX_LINKS else "good" if stops >= LOW_STOPS else "near"
    if has_body:
        return "short" if n < LONG else "near"
    if links > MAX_LINKS or "©" in b.text:
        return "bad"
    if n < SHORT:
        return "bad" if links > 0 else "short"
    if stops >= HIGH_STOPS:
        return "good" if n >= LONG else "near"
    return "near" if stops >= LOW_STOPS or not words else "bad"


def _neighbours(labels: list[str], kinds: tuple[str, ...]) -> list[tuple[str | None, str | None]]:
    """For each block the nearest label of these kinds before and after it."""
    sides = []
    for own in (labels, labels[::-1]):
        last, side = None, []
        for x in own:
            side.append(last)
            last = x if x in kinds else last
        sides.append(side)
    return list(zip(sides[0], sides[1][::-1], strict=True))


def _second_pass(found: list[_Block], first: list[str]) -> list[bool]:
    """Labels of blocks that are each other's neighbours."""
    if not {"good", "near"} & set(first):  # a page of short blocks: what is not boilerplate is its text
        return [x == "short" for x in first]
    out = []
    for b, x, (p, q), (near_p, near_q) in zip(found, first, _neighbours(first, ("good", "bad")), _neighbours(first, ("good", "bad", "near")), strict=True):
        if x in ("good", "bad"):
            out.append(x == "good")
        elif b.kind in _HEADINGS:
            out.append(near_q in ("good", "near") or (near_q is None and p == "good"))
        elif x == "near":
            out.append("good" in (p, q) or (p is None and q is None) or (b.inside == "body" and None in (p, q)))
        elif p == q or None in (p, q):
            out.append((p or q) != "bad")
        else:  # between text and boilerplate: the side of what leans to text
            out.append((near_p == "near" and q == "good") or (near_q == "near" and p == "good"))
    return out


def classify(found: list[_Block]) -> list[bool]:
    """Whether each block is main text."""
    has_body = any(b.inside == "body" for b in found)
    first = [_first_pass(b, has_body) for b in found]
    if not has_body:  # what the markup has removed is no neighbour
        rest = [i for i, b in enumerate(found) if b.inside != "part"]
        labels = dict(zip(rest, _second_pass([found[i] for i in rest], [first[i] for i in rest]), strict=True))
        return [labels.get(i, False) for i in range(len(found))]
    body = [i for i, b in enumerate(found) if b.inside == "body"]
    labels = dict(zip(body, _second_pass([found[i] for i in body], [first[i] for i in body]), strict=True))
    known = [("good" if labels[i] else "bad") if i in labels else x for i, x in enumerate(first)]
    return [labels.get(i, p == q == "good" and known[i] != "bad") for i, (p, q) in enumerate(_neighbours(known, ("good", "bad")))]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, good in zip(found, classify(found), strict=True) if good)


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every row of pages(page_id, url, html, ...): page_id, url, text, n_chars (code points).

    Null or empty html, and pages without main text, give an empty text. Broken or cut-off markup is read as far as it goes.
    Repeated rows get equal results; null ids and urls stay null. Other columns are ignored; no rows give no rows.
    """

    def run(batches):
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            texts = [main_text(x.as_py()) for x in get("html")]
            yield pa.RecordBatch.from_arrays([get("page_id"), get("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
