"""Main-text extraction from HTML by the maximum-scoring contiguous region.

A page is read as a sequence of words and tags. A word's score is the sum of the log-odds of the place it stands in, held to
-1 to 1: of its open blocks' names, classes, ids and roles; of the share of links in its block; of the size and links of
the innermost element whose class no labelled page has; and, where the page names its main text (``article`` or
``main`` elements that aren't boilerplate themselves), of being inside or outside it, by the share of the words that it
holds. A tag's score is negative, by the log-odds of its name. All log-odds are counted on labelled pages
(:data:`LABELLED`: short pages whose main text is marked). One linear scan finds the
contiguous region with the greatest sum. The text of the region is what remains of it without the elements that the weights
know as menus, notices, adverts, comments and the like, which count nothing in the scan, and without words outside
the main text that the page names, if that holds more than a few of the page's words.

What an element's class says, it says of words that stand in that element only. So ``html`` and ``body`` are never boilerplate; nor are inline
elements, nor the paragraphs, list items, cells and code of a named main text; a header that is nothing but the page's only title is none; and an
element that holds the page's content (an element named as such with most of its words, without much else on the page)
is a wrapper, whatever its class. Small boxes of unlisted classes score low, unless they hold a whole sentence. A page without any word of positive score
is scanned again with all words but those of known boilerplate at 1, and one that gave no text at all with every word that is page text.

Text: character references are decoded; block elements part blocks; white space inside a block becomes one
space; blocks are trimmed and joined by a line end; nothing else is dropped. Unclosed tags end with their parent,
and an unfinished tag at the end of a cut page is dropped.

Defined results: null, empty and tag-only pages have the empty text; pages are judged each on its own, so repeated rows and null
ids need no care; an empty table gives an empty result; other columns pass through, and one named like the
output column, in any case, is replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)
    |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)
    |<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)""", re.S | re.X)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PIECE = re.compile(r"[a-z]+")
# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset("""address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td
    tfoot th thead tr ul video audio canvas object svg template search""".split())
#: name: (open elements that its start tag ends, elements beyond which it ends none).
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
        "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCKS - {"button", "option", "optgroup", "summary", "legend", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "head", "html", "video",
                   "audio", "canvas", "object", "svg", "template", "select"}
#: Start tags that may stand in a head; any other one, and text, ends an open head (its end tag may be left out).
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Elements whose own words aren't page text at all.
NEVER = frozenset("head script style title noscript iframe textarea select option button template svg object audio video canvas datalist".split())

#: Labelled pages: the main text stands between <main-text> and </main-text>, which are no part of the page.
MAIN = ("article", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Parts of a text, whose class does not make them boilerplate inside a named main text.
PARTS = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 td th tr pre blockquote".split())
LABELLED = (
    """<body><header class="masthead"><h1>Site name</h1><p>our motto here</p></header><nav><ul><li><a>home page</a></li><li><a>news today</a></li></ul></nav>
    <div class="ad">buy this thing now</div><main-text><article><h1>The title of it</h1><p>many words of the text stand here in a row</p><p><b>more</b> words of
    the text are here too</p><ul><li>one point in the list</li></ul></article></main-text><aside class="sidebar"><h3>related posts</h3><ul><li><a>other text</a></li></ul></aside><section class="comments" id="comments"><h2>reader comments</h2><div class="comment"><p>first reader says this</p></div></section>
    <footer><p>all rights reserved by us</p></footer></body>""",
    """<body><div id="nav" class="menu navigation"><a>home</a><a>about us</a></div><div class="cookie notice banner"><p>we use cookies on this site</p><button>accept</button></div>
    <main-text><div class="content post"><h2>A heading stands here</h2><p>the words of the post are long and go on</p><blockquote><p>somebody said these words once</p></blockquote>
    <pre>some code is here</pre><table><tr><td>cells have words too</td></tr></table></div></main-text><div class="advert sponsored promo"><p>cheap things for you</p></div>
    <form class="subscribe newsletter signup"><label>your mail</label><p>sign up for our letter</p></form><div id="footer" class="footer copyright"><p>some rights reserved</p></div></body>""",
    """<body><div role="navigation" class="breadcrumb breadcrumbs"><a>home</a><a>topic</a></div><div role="banner" class="header masthead"><p>the paper of the town</p></div>
    <main-text><main><section><h1>What it is about</h1><p>here goes the story with its many words</p><figure><figcaption>what the picture shows</figcaption></figure><h3>a part</h3><p>and so <a>it all ends</a> at <em>last</em></p></section></main></main-text><div class="social share sharing"><p>share this on the net</p></div><div class="related recommended"><p>read this next</p></div>
    <div class="widget sidebar"><p>popular this week</p></div><div id="disqus" class="reply replies respond"><p>a reply from a reader</p></div><div role="contentinfo"><p>contact us here</p></div></body>""",
    """<body><div class="alert popup modal overlay"><p>you have free texts left</p></div><div class="paywall subscription"><p>become a member now</p></div><div role="search"><p>search here</p></div>
    <main-text><div class="entry story"><p>plain words in a plain page</p><p>which go on and on</p></div></main-text><div class="ads adsense advertisement sponsor"><p>an offer for you</p></div>
    <div class="consent gdpr cookies notification"><p>agree to all this</p></div><div role="complementary" class="toolbar pagination pager"><p>next page</p></div>
    <div class="login signin register"><p>log in here</p></div><div class="disclaimer"><p>no warranty at all</p></div></body>""",
    """<body><div class="bar"><p>the line at the top of it all</p></div><main-text><div class="text"><h2>A long tale</h2><p>the tale is told in a plain part of the page and
    has many more words than what stands next to it for it is what the reader came for</p><p>so the next part goes on with <a>one link</a> and with more words until the tale has been told</p><h3>What to take along</h3><ul><li>some bread and some milk for the long way home</li><li>a coat for the cold part of it</li></ul><ol><li>first go up the hill</li><li>then come down to the lake</li></ol></div></main-text><article><h3>next tale</h3><p>it starts like so</p></article><article class="card teaser"><p>one more to read</p></article>
    <div class="trending"><ul><li><a>what all read</a></li><li><a>what some read</a></li></ul></div><section class="comments"><article><p>what a tale it was</p></article><article><p>not for me</p></article></section></body>""",
    """<body><div class="breaking"><p>new on the site</p></div><p>go to the words</p><main-text><article class="single"><h1>How it went</h1><p>on the first day it went well and all the people that were there said so to each other</p><ul><li><a>one thing</a> to know of</li><li>and another one that took them all day long</li></ul><h3>Who was there</h3><ul><li>all of the old town</li><li>half of the new town</li></ul>
    <p>on the last day it went as well as it had on the first</p></article></main-text><div class="readmore"><p>more from this town</p><ul><li><a>the town hall</a></li><li><a>the town well</a></li></ul></div><p>write to us</p><div class="tags"><a>town</a><a>day</a></div></body>""",
    """<body><div class="tagline"><p>all that is new</p></div><main-text><div><p>a page may have no names at all for its parts and still has words in a row that make up its text</p><p>they stand in one long part of it and the rest is short</p></div></main-text>
    <article><p>short one</p></article><div class="mostread"><ul><li><a>most read one</a></li><li><a>most read two</a></li></ul></div></body>""",
)


class Node:
    """An open element: what it is, and what it inherits from the elements around it."""

    __slots__ = ("parent", "name", "words", "block", "main", "linked", "heading", "never", "keys", "unlisted", "count", "links", "sentence", "hard", "header", "boiler")

    def __init__(self, parent: Node | None, name: str, words: tuple = ()):
        self.parent, self.name, self.words = parent, name, words
        is_block = name in BLOCKS
        self.block = self if is_block or parent is None else parent.block
        self.main = self if name in MAIN else parent and parent.main
        self.linked = name == "a" or bool(parent and parent.linked)
        self.heading = name in HEADINGS or bool(parent and parent.heading)
        self.never = name in NEVER or bool(parent and parent.never)
        self.keys, self.unlisted = (parent.keys, parent.unlisted) if parent else (frozenset(), None)
        if is_block and name not in ("html", "body"):
            own = keys(self)
            if not self.keys.issuperset(own):
                self.keys = self.keys.union(own)
        self.count = self.links = 0
        self.sentence = self.hard = self.header = self.boiler = False


def parse(page: str) -> tuple[list[tuple], list[Node]]:
    """The page in order, ("text", str, node) and ("tag", name, node), and its nodes, parents first.

    A node is the innermost open element: for a start tag the element itself, for an end tag what it leaves open.
    """
    root = Node(None, "")
    stack, open_, nodes, tokens = [root], Counter(), [root], []
    at, n = 0, len(page)

    def cut(k: int) -> None:
        for e in stack[k:]:
            open_[e.name] -= 1
        del stack[k:]

    while at < n:
        m = TOKEN.search(page, at)
        lo = m.start() if m else n
        if lo > at:
            if stack[-1].name == "head" and not page[at:lo].isspace():
                cut(len(stack) - 1)
            tokens.append(("text", page[at:lo], stack[-1]))
        if not m:
            break
        at = m.end()
        name, attrs = (m["name"] or m["name2"] or "").lower(), m["attrs"] or m["attrs2"] or ""
        if not name:
            continue
        if page[at - 1] != ">":
            break  # the page ends inside a tag
        ends = m["end"] or m["end2"]
        if ends:
            if open_[name]:
                _close(stack, name, cut)
        elif name == "head" and any(e.name != "html" for e in stack[1:]):
            continue  # a head inside a body is none
        else:
            _make_room(stack, open_, name, cut)
            node = Node(stack[-1], name, tuple(w for v in NAMED.finditer(attrs) for w in PIECE.findall((v[1] or v[2] or v[3] or "").lower())))
            nodes.append(node)
            stack.append(node)
            open_[name] += 1
        tokens.append(("tag", name, stack[-1]))
        if not ends and (name in VOID or name in RAW):
            if name in RAW:
                last = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = last.end() if last else n
            cut(len(stack) - 1)
    return tokens, nodes


def _close(stack: list[Node], name: str, cut) -> None:
    """An end tag ends its nearest open element; one of an inline element none beyond a block."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].name == name:
            return cut(k)
        if name not in BLOCKS and stack[k].name in BLOCKS:
            return None
    return None


def _make_room(stack: list[Node], open_: Counter, name: str, cut) -> None:
    """Ends the open elements that a start tag ends without saying so."""
    if name not in HEAD and open_["head"]:
        head = next((k for k, e in enumerate(stack[1:3], 1) if e.name == "head"), None)
        if head is not None and not any(e.name == "template" for e in stack[head:]):
            cut(head)
    ends, wall = ENDS.get(name, (set(), set()))
    if name in ENDS_P:
        ends, wall = ends | {"p"}, wall | {"td", "th", "button", "caption"}
    if not any(open_[e] for e in ends):
        return
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].name in ends:
            return cut(k)
        if stack[k].name in wall:
            return


def marked(page: str) -> tuple[list[tuple], list[Node], list[bool]]:
    """The tokens and nodes of a labelled page, and whether each token is of its main text."""
    before, rest = page.split("<main-text>")
    inside, after = rest.split("</main-text>")
    (tokens, nodes), n, m = parse(before + inside + after), len(parse(before)[0]), len(parse(before + inside)[0])
    return tokens, nodes, [n <= k < m for k in range(len(tokens))]


def keys(e: Node) -> tuple[str, ...]:
    """What an open element is looked up by; one of :data:`MAIN` also by each class with its name, as a class may make
    a teaser of an article and not of other elements."""
    return (e.name, *e.words, *(f"{e.name}.{w}" for w in e.words)) if e.name in MAIN else (e.name, *e.words)


def above(e: Node | None):
    while e is not None and e.parent is not None:
        yield e
        e = e.parent


def log_odds(inside: Counter, outside: Counter, smooth: float = 0.5) -> dict[str, float]:
    a, b = sum(inside.values()), sum(outside.values())
    return {k: math.log((inside[k] + smooth) / (a + smooth)) - math.log((outside[k] + smooth) / (b + smooth)) for k in {*inside, *outside}}


def learn(pages: tuple[str, ...] = LABELLED) -> dict[str, float]:
    """Log-odds of main text, by words, for every name, class, id and role that words of the labelled pages stand in."""
    inside, outside = Counter(), Counter()
    for page in pages:
        tokens, _, is_main = marked(page)
        for (kind, what, here), main in zip(tokens, is_main, strict=True):
            if kind == "text":
                for key in {k for e in above(here) for k in keys(e) if not (e.name in MAIN and k in e.words)}:
                    (inside if main else outside)[key] += len(what.split())
    return log_odds(inside, outside)


WEIGHTS = learn()
#: Words with a key below this are boilerplate (links tell by their share only). It counts nothing, so that a long advert inside an article doesn't part it.
BOILERPLATE = -1.0
#: A tag of even odds (a heading of one word must outweigh the tags up to the next words), and the bounds of a word's score.
TAG, BOUND = -0.02, 1.0
#: Bins of a place: shares of links; words and share of the page below which an element is small; share of the main text
#: that the page names.
SOME_LINKS, ALL_LINKS = 1 / 3, 0.9
SMALL_WORDS, SMALL_SHARE = 30, 0.25
FEW = 0.2


#: A wrapper's content holds more than this share of its words, and what is else on the page less than this share of the wrapper's.
CONTENT_SHARE, ELSE_SHARE = 0.5, 0.25
#: The end of a sentence.
SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][\"'\u201d\u2019\u00bb)\]]*\s*$")


def says_boilerplate(e: Node, weights: dict[str, float]) -> bool:
    """Whether an element's own name, class, id or role says that its words are boilerplate."""
    if e.name in ("html", "body") or e.name not in BLOCKS or e.main is not None and e.main is not e and e.name in PARTS:
        return False
    return any(weights.get(key, 0.0) < BOILERPLATE for key in keys(e) if key != "a")


def is_head(e: Node, weights: dict[str, float]) -> bool:
    """Whether it is the header of a named main text: its headings are text."""
    return e.main is not None and e.main is not e and all(key in ("a", "header") or weights.get(key, 0.0) >= BOILERPLATE for key in keys(e))


def mark(tokens: list[tuple], nodes: list[Node], weights: dict[str, float]) -> int:
    """Sets what is known of the nodes once the page is read; the page's words that aren't boilerplate."""
    titles = sum(e.name == "h1" for e in nodes)
    for e in nodes:
        if e.parent is not None:
            own = e.words and e.name in BLOCKS and e.name not in ("html", "body") and not any(key in weights for key in keys(e)[1:])
            e.unlisted = e if own else e.parent.unlisted
    titled: Counter = Counter()  # words in the headings of a node
    in_header: set[Node] = set()
    for kind, what, here in tokens:
        if kind == "text" and not here.never:
            n = len(what.split())
            here.count += n
            here.links += n if here.linked else 0
            here.sentence = here.sentence or bool(n and SENTENCE.search(what))
            if here.heading:
                titled[here] += n
                up = next((e for e in above(here) if e.name in HEADINGS), None)
                if up is not None and up.name == "h1":
                    in_header.add(here)
    content: dict[Node, int] = {}  # words of the largest content element in a node
    heads: set[Node] = set(in_header)
    for e in reversed(nodes):
        p = e.parent
        if p is None:
            continue
        named = e.name == "main" or any(weights.get(k, 0.0) > 0 for k in (keys(e) if e.name in MAIN else e.words)) if e.name in BLOCKS else False
        largest = max(content.get(e, 0), e.count if named and not says_boilerplate(e, weights) else 0)
        content[p] = max(content.get(p, 0), largest)
        p.count, p.links, p.sentence = p.count + e.count, p.links + e.links, p.sentence or e.sentence
        titled[p] += titled[e]
        if e in heads:
            heads.add(p)
    wrappers: set[Node] = set()

    def flag() -> int:
        left = 0
        for e in nodes:
            own = e not in wrappers and says_boilerplate(e, weights)
            if own and titles == 1 and e in heads and titled[e] == e.count and e.name in ("header", "div", "section"):
                own = False  # the page's only title
            head = own and is_head(e, weights)
            up = e.parent
            e.header = head or bool(up and up.header)
            e.hard = e.never or own and not head or bool(up and up.hard)
            e.boiler = e.hard or e.header and not e.heading
        for kind, what, here in tokens:
            if kind == "text" and not here.boiler:
                left += len(what.split())
        return left

    left = flag()
    for e in nodes:  # outermost first
        if e.boiler and not e.never and not (e.parent and e.parent.boiler) and content.get(e, 0) > CONTENT_SHARE * e.count and left < ELSE_SHARE * e.count:
            wrappers.add(e)
            left = flag()
    return left


def _links(n: int, of: int) -> str:
    return "all" if n >= ALL_LINKS * of else "some" if n >= SOME_LINKS * of else "few"


def contexts(tokens: list[tuple], nodes: list[Node], weights: dict[str, float]) -> dict[Node, tuple[str, ...] | None]:
    """What else tells of the words in each of a page's places; None for boilerplate."""
    total = mark(tokens, nodes, weights)
    words, links, named, names_main = Counter(), Counter(), 0, False
    for kind, what, here in tokens:
        if here.boiler:
            continue
        if kind == "text":
            n = len(what.split())
            words[here.block] += n
            links[here.block] += n if here.linked else 0
            named += n if here.main is not None else 0
        elif what in MAIN:
            names_main = True
    out: dict[Node, tuple[str, ...] | None] = {}
    for e in nodes:
        if e.boiler:
            out[e] = None
            continue
        own = [f"links {_links(links[e.block], words[e.block])}"] if words[e.block] else []
        box = e.unlisted
        if box is not None:
            size = "small" if box.count < SMALL_WORDS and box.count < SMALL_SHARE * total else "large"
            if size == "large" or not box.sentence or box.links >= SOME_LINKS * box.count:
                own.append(f"unlisted {size} links {_links(box.links, box.count)}")
        if names_main and named:
            own.append(f"{'inside' if e.main is not None else 'outside'} {'few' if named < FEW * total else 'most'}")
        out[e] = tuple(own)
    return out


def learn_contexts(pages: tuple[str, ...] = LABELLED) -> tuple[float, dict[str, float]]:
    """Log-odds of a word that isn't boilerplate, and of what else tells of it. A page is read with the weights of
    the others, so that its own classes are listed or not as those of any page are."""
    inside, outside, all_in, all_out = Counter(), Counter(), 0, 0
    for k, page in enumerate(pages):
        tokens, nodes, main = marked(page)
        known = contexts(tokens, nodes, learn(pages[:k] + pages[k + 1:]))
        for (kind, what, here), is_main in zip(tokens, main, strict=True):
            if kind == "text" and known[here] is not None:
                n = len(what.split())
                all_in, all_out = all_in + n * is_main, all_out + n * (not is_main)
                for key in known[here]:
                    (inside if is_main else outside)[key] += n
    # Of each key, against all words: a word has one key of a kind or none.
    return math.log(all_in / all_out), {k: math.log((inside[k] + 0.5) / (all_in + 0.5)) - math.log((outside[k] + 0.5) / (all_out + 0.5))
                                        for k in {*inside, *outside}}


PRIOR, CONTEXTS = learn_contexts()


def place(here: Node, context: tuple[str, ...] | None) -> float:
    """The score of a word that stands in this element."""
    if context is None:
        return 0.0
    own = (WEIGHTS.get(key, 0.0) for key in here.block.keys)  # what would be boilerplate was judged not to be, for this page
    total = PRIOR + sum(w for w in own if w >= BOILERPLATE) + sum(CONTEXTS.get(key, 0.0) for key in context)
    return max(-BOUND, min(BOUND, total))


def tag(name: str) -> float:
    """The score of a tag: the more, the likelier it is in main text."""
    return TAG * math.exp(-max(-BOUND, min(BOUND, WEIGHTS.get(name, 0.0))))


def best_region(tokens: list[tuple], scores: dict[Node, float], known: dict[Node, tuple[str, ...] | None]) -> tuple[int, int]:
    """The tokens from and to which the sum of scores is greatest."""
    best, best_span, total, first = 0.0, (0, 0), 0.0, 0
    for k, (kind, what, here) in enumerate(tokens):
        if known[here] is not None:
            total += scores[here] * len(what.split()) if kind == "text" else tag(what)
        if total <= 0:
            total, first = 0.0, k + 1
        elif total > best:
            best, best_span = total, (first, k + 1)
    return best_span


def _text(tokens: list[tuple], taken: set[Node]) -> str:
    blocks: list[list[str]] = [[]]
    for kind, what, here in tokens:
        if kind == "tag":
            if what in BLOCKS:
                blocks.append([])
            elif what == "br":
                blocks[-1].append(" ")
        elif here in taken:
            blocks[-1].append(what)
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    tokens, nodes = parse(page)
    known = contexts(tokens, nodes, WEIGHTS)
    scores = {here: place(here, context) for here, context in known.items()}
    if not any(kind == "text" and scores[here] > 0 and not what.isspace() for kind, what, here in tokens):
        scores = {here: 0.0 if context is None else 1.0 for here, context in known.items()}
    taken = {here for here, context in known.items() if context is not None and (scores[here] > 0 or "outside most" not in context)}
    first, end = best_region(tokens, scores, known)
    return _text(tokens[first:end], taken) or _text(tokens, {e for e in nodes if not e.never})


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` without the html, with ``out_col``: the main text of every page."""
    @F.pandas_udf("string")
    def text_of(values: pd.Series) -> pd.Series:
        return pd.Series([main_text(v if isinstance(v, str) else None) for v in values], dtype=object)

    own = [F.col(f"`{c}`") for c in pages.columns if c != html_col and c.lower() != out_col.lower()]
    return pages.select(*own, text_of(F.col(f"`{html_col}`").cast("string")).alias(out_col))
