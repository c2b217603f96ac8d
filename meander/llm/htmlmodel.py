"""HTML extraction with a tree-structured graphical model.

Every block element and every text block of a page is a node with two states, content or not.  Unary potentials come
from a logistic regression on the node's own features (element, names in class, id and role, text and link amounts);
parent-child potentials are tables per kind of parent.  Both are learned piece by piece from labelled pages.
Sum-product messages upward and downward give exact marginals; text blocks whose marginal is at least 0.5 are the main
text, joined in page order.

Labelled pages are of two kinds: the small pages of ``LABELLED``, in which elements are marked, and a bounded sample
of the table's own pages that hold exactly one ``article`` or ``main`` element, which says what is content but for
navigation, asides, forms, footers and what its names call comments, notices, adverts or boxes.  The sample has at most
``max_train`` pages of at most ``max_chars`` characters (longer ones are read like all others, but not learned from).  The
model also learns from copies of the sample: some hide sectioning names, others have such blocks (``BLOCKS_AROUND``) put
into and behind the article, with sentences of other pages, so that only element and names tell them from the article.

Null and empty pages give an empty text; repeated rows give equal results; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meander.llm.common import sliced
from meander.llm.htmltree import Page, parse

TAGS = ("#root #text html body div section article main nav aside header footer form ul ol li dl p h1 h2 h3 h4 h5 h6 "
        "table tr td th blockquote pre figure figcaption address fieldset details").split()
_TAG = {t: i for i, t in enumerate(TAGS)}
#: Kinds of words in class, id and role attributes.
NAMES = {
    "menu": r"nav|menu|breadcrumb|toc|pagination|pager|tabs?\b",
    "frame": r"header|masthead|footer|banner|topbar|toolbar|copyright|colophon",
    "side": r"side|aside|related|recommend|widget|popular|trending|complementary",
    "notice": r"cookie|consent|notice|alert|gdpr|popup|modal|overlay|paywall|disclaimer",
    "advert": r"\bads?\b|\bad-|-ad\b|advert|sponsor|promo|commercial|teaser",
    "form": r"form|search|subscribe|newsletter|signup|login|contact",
    "comment": r"comment|disqus|respon|reply|discussion|review",
    "share": r"share|social|tools?\b|author|byline|meta|tags?\b",
    "content": r"article|content|main|post|entry|story|body|text|prose",
}
_NAMES = [re.compile(p) for p in NAMES.values()]
#: Kinds of parents that have tables of their own.
PARENTS = {"#root": 0, "html": 0, "body": 0, "div": 1, "section": 1, "article": 2, "main": 2}
OTHER_PARENT, NAMED_PARENT, N_PARENTS = 3, 4, 5  # named: as no part of an article

#: Names of what is no part of an article, wherever it stands.
NO_ARTICLE = re.compile(
    r"\b(comments?|comment[-_]?(list|section|thread|body|area)|commentlist|replies|respond|disqus|discussion|"
    r"cookies?|consent|gdpr|notices?|alerts?|popup|modal|paywall|disclaimer|"
    r"ads?|ad[-_](slot|box|unit|banner|container)|adverts?|advertisement|advertising|sponsor(ed)?|promo|promoted|"
    r"related|recommended|recommendations|sidebar|widget|popular|trending|newsletter|subscribe|subscription|signup)\b")

# Own small pages; c marks content, everything else is not.
LABELLED = [
    "<body><header><div class=logo>Site name</div><ul class=menu><li><a>Home</a><li><a>News</a><li><a>About</a></ul>"
    "</header><div class=cookie-notice><p>We use cookies to improve this site. <a>Accept</a></p></div>"
    "<div id=content><h1 c>A title of the story</h1><p c>First long paragraph of the story, with several words, a "
    "comma and an end.</p><h2 c>Part</h2><p c>Second paragraph, which goes on for a while and says something more.</p>"
    "<ul c><li c>first point of the list<li c>second point of the list</ul></div><aside class=sidebar><h3>Related"
    "</h3><ul><li><a>Other story one</a><li><a>Other story two</a></ul></aside><div class=comments><h3>2 comments"
    "</h3><div class=comment><p>I liked this text very much, thank you for it.</p></div><div class=comment><p>I do "
    "not agree with the second paragraph at all, sorry.</p></div></div><footer><p>Copyright of the site</p></footer>",
    "<body><nav><a>One</a> <a>Two</a> <a>Three</a></nav><main><article c><header c><h1 c>Title</h1></header><p c>Text "
    "of the article, long enough to look like one, with a full stop.</p><blockquote c><p c>A quoted sentence stands "
    "here.</p></blockquote><p c>Short end.</p></article><div class=share><a>Share</a> <a>Mail</a></div><section "
    "class=comments><article class=comment><p>A reader says a few words about the page here.</p></article></section>"
    "</main><form class=newsletter><p>Sign up for our letter</p><label>Mail</label></form><footer><ul><li><a>Imprint"
    "</a><li><a>Privacy</a></ul></footer>",
    "<body><div class=topbar>Call us now</div><div class=nav><ul><li><a>Shop</a><li><a>Blog</a></ul></div><div "
    "class=wrapper><div class=post c><h1 c>Entry</h1><div class=entry c><p c>The entry begins with this sentence and "
    "continues with another one.</p><div class=advert><p>Buy this thing today, it is cheap and good.</p></div><p c>It "
    "goes on after the advert, as entries do, for one more line.</p><table c><tr c><td c>cell one<td c>cell two"
    "</table></div></div><div class=widget><p>Popular this week</p><p><a>Some story</a></p></div></div><div "
    "class=disclaimer><p>All opinions are those of the authors and nobody else.</p></div><div id=footer>Contact and "
    "terms</div>",
    "<body><div class=alert><p>The site will be down for a short time on Sunday.</p></div><section class=story c><p "
    "c>Only a short story, told in two sentences. This is the second one of them.</p><pre c>some code here</pre><h3 "
    "c>End</h3><p c>Bye.</p></section><div class=sponsor>Paid content by a company, read more about it there.</div>"
    "<section id=respond><h3>Leave a reply</h3><form><p>Your name and your words</p></form></section>",
    "<body><header>Name of the site</header><article c><h1 c>Heading</h1><p c>One.</p><p c>The second one is longer, and "
    "has a comma.</p><aside>More stories for you, picked by our editors</aside><p c>Third one.</p><section "
    "class=comments><h2>Comments</h2><p>What a fine text this is, thank you.</p><p>I think so too.</p></section>"
    "<footer>Filed under news</footer></article><aside>Recent posts are listed here, one by one</aside><footer>All "
    "rights reserved</footer>",
    "<body><header><p>Welcome to the site, dear reader of these pages.</p></header><article c><h2 c>Name</h2><p c>Some "
    "words.</p><nav><a>Next</a> <a>Previous</a></nav><form><p>Tell us what you think of it</p></form><ul "
    "class=comments><li>First reader was here, and liked it.</li><li>Second reader too.</li></ul><div "
    "class=ad>Cheap flights to everywhere, only this week.</div><div class=cookie>This page keeps cookies.</div>"
    "</article><aside><p>A box at the side with some text in it, not of the article.</p></aside>",
    "<div c><p c>A page without any frame around it, only this paragraph.</p><p c>And one more.</p></div>",
    "<p c>A single paragraph is all there is on this page, which is fine.</p>",
    "<body c>Bare text in the body of a page, without any element in it at all.</body>",
    "<body><header>The Daily</header><div class=text c><h1 c>Name</h1><p c>A paragraph under a heading, long enough to "
    "be read.</p></div><footer>Terms</footer>",
    "<body><header>Shop</header><nav><a>Start</a></nav><section c><p c>Words of the section, all of them good, and a "
    "stop.</p></section><footer>Help</footer>",
    "<body><aside><p>Side box, first of all things on the page.</p></aside><main c><p c>The text proper, which is not "
    "long.</p><div class=comment-list><p>Reader words, as long as the text itself is.</p></div></main>",
]


@dataclass
class Model:
    weights: np.ndarray  # per feature, the last one constant
    tables: list[tuple[float, float, float, float]]  # per kind of parent: log potentials (0,0) (0,1) (1,0) (1,1)


def features(page: Page) -> np.ndarray:
    """Nodes x features: element, names, amounts of text below."""
    n = len(page.tag)
    size, linked, stops = (np.zeros(n) for _ in range(3))
    for i in range(n):
        if t := page.text[i]:
            size[i], linked[i] = len(t), page.linked[i]
            stops[i] = t.count(".") + t.count(",") + t.count("!") + t.count("?")
    own = size.copy()
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        size[p] += size[i]
        linked[p] += linked[i]
        stops[p] += stops[i]
    out = np.zeros((n, len(TAGS) + len(NAMES) + 8))
    for i in range(n):
        if (k := _TAG.get(page.tag[i])) is not None:
            out[i, k] = 1.0
        if page.names[i]:
            for j, pattern in enumerate(_NAMES):
                out[i, len(TAGS) + j] = pattern.search(page.names[i]) is not None
    k = len(TAGS) + len(NAMES)
    share = linked / np.maximum(size, 1.0)
    total = max(size[0], 1.0)
    out[:, k] = np.log1p(size) / 5.0
    out[:, k + 1] = share
    out[:, k + 2] = np.minimum(stops / np.maximum(size, 1.0) * 20.0, 2.0)
    out[:, k + 3] = size / total
    out[:, k + 4] = (own > 0) * share
    out[:, k + 5] = (own > 0) * np.log1p(own) / 5.0
    out[:, k + 6] = np.arange(n) / n
    out[:, k + 7] = 1.0
    return out


def _kinds(page: Page) -> list[int]:
    """The kind of parent that each node is."""
    return [NAMED_PARENT if names and NO_ARTICLE.search(names) else PARENTS.get(tag, OTHER_PARENT)
            for tag, names in zip(page.tag, page.names, strict=True)]


def _log_ratio(x1: float, y1: float, x0: float, y0: float) -> float:
    """log((e^x1 + e^y1) / (e^x0 + e^y0))."""
    m1, m0 = max(x1, y1), max(x0, y0)
    return m1 - m0 + log((exp(x1 - m1) + exp(y1 - m1)) / (exp(x0 - m0) + exp(y0 - m0)))


def marginals(model: Model, page: Page) -> np.ndarray:
    """Log odds of content for every node, by exact sum-product on the tree."""
    belief = (features(page) @ model.weights).tolist()
    n, parent, kinds = len(belief), page.parent, _kinds(page)
    up = [0.0] * n
    for i in range(n - 1, 0, -1):
        p = parent[i]
        t = model.tables[kinds[p]]
        up[i] = _log_ratio(t[2], t[3] + belief[i], t[0], t[1] + belief[i])
        belief[p] += up[i]
    for i in range(1, n):
        p = parent[i]
        t = model.tables[kinds[p]]
        rest = belief[p] - up[i]
        belief[i] += _log_ratio(t[1], t[3] + rest, t[0], t[2] + rest)
    return np.array(belief)


def main_text(model: Model, html: str | None) -> str:
    page = parse(html)
    odds = marginals(model, page)
    return "\n".join(t for t, o in zip(page.text, odds, strict=True) if t and o >= 0)


def _labels(page: Page, inside: list[bool]) -> np.ndarray:
    """1 for text blocks inside; elements by the larger part of the text below them."""
    n = len(page.tag)
    good, size = np.zeros(n), np.zeros(n)
    for i in range(n - 1, -1, -1):
        if page.text[i]:
            size[i] = len(page.text[i])
            good[i] = size[i] * inside[i]
        if i:
            size[page.parent[i]] += size[i]
            good[page.parent[i]] += good[i]
    return (good * 2 > size).astype(float)


def _marked(html: str) -> tuple[Page, np.ndarray]:
    """A page of ``LABELLED``: the mark ``c`` is read as a name."""
    page = parse(re.sub(r"\sc(?=[\s>])", " role='##c'", html))
    content = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        content[i] = content[page.parent[i]] if page.tag[i] == "#text" else "##c" in page.names[i]
    page.names = [n.replace("##c", "").strip() for n in page.names]
    return page, _labels(page, content)


_OUTSIDE = ("nav", "aside", "form", "footer")


def _sectioned(page: Page) -> np.ndarray | None:
    """Labels of a page that says itself what its article is."""
    tops = [i for i, t in enumerate(page.tag) if t in ("article", "main") and _NOISE not in page.names[i]]
    if len(tops) != 1:
        return None
    inside = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        out = page.tag[i] in _OUTSIDE or _NOISE in page.names[i] or NO_ARTICLE.search(page.names[i])
        inside[i] = i == tops[0] or (inside[page.parent[i]] and not out)
    return _labels(page, inside)


#: Elements and names of blocks around an article; ``{}`` is their content.
BLOCKS_AROUND = [
    "<section class=comments>{}</section>", "<section id=comments>{}</section>", "<div class=comments>{}</div>",
    "<div id=comments>{}</div>", "<article class=comment>{}</article>", "<ul class=comments>{}</ul>",
    "<ol class=comment-list>{}</ol>", "<div class=comment>{}</div>", "<div class=discussion>{}</div>",
    "<section class=replies>{}</section>", "<div id=respond>{}</div>",
    "<div class=ad>{}</div>", "<div class=advert>{}</div>", "<div class=ad-slot>{}</div>", "<div class=ads>{}</div>",
    "<section class=sponsored>{}</section>", "<div class=promo>{}</div>", "<p class=advertisement>{}</p>",
    "<aside>{}</aside>", "<aside class=box>{}</aside>", "<div class=sidebar>{}</div>", "<div class=related>{}</div>",
    "<section class=related-stories>{}</section>", "<div class=recommended>{}</div>", "<div class=widget>{}</div>",
    "<footer>{}</footer>", "<footer class=page-footer>{}</footer>", "<form>{}</form>", "<form class=newsletter>{}</form>",
    "<div class=newsletter>{}</div>", "<div class=signup>{}</div>", "<div class=search-form>{}</div>",
    "<div class=cookie-notice>{}</div>", "<div class=cookie>{}</div>", "<div class=notice>{}</div>",
    "<div class=alert>{}</div>", "<div class=consent>{}</div>", "<p class=disclaimer>{}</p>",
    "<nav>{}</nav>", "<nav class=menu>{}</nav>", "<ul class=menu>{}</ul>", "<div class=breadcrumb>{}</div>",
    "<div class=share>{}</div>",
]
_INNER = ["<p>{0}</p>", "{0}", "<p>{0}</p><p>{1}</p>", "<h3>{2}</h3><p>{0}</p>", "<div><p>{0}</p></div>",
          "<ul><li>{0}</li><li>{1}</li></ul>", "<ul><li><a>{2}</a></li><li><a>{3}</a></li></ul>",
          "<div class=comment><p>{0}</p></div><div class=comment><p>{1}</p></div>", "<p>{0}<br>{1}</p>"]
_NOISE = "##x"
_LIST = ["<li>{0}</li><li>{1}</li>", "<li><p>{0}</p></li>", "<li><a>{2}</a></li><li><a>{3}</a></li>"]


def _surrounded(html: str, sentences: list[str], rng) -> str:
    """``html`` with a few blocks put into and behind its article, marked for the labels."""
    ends = [m.start() for m in re.finditer(r"(?i)</(article|main)\s*>", html)]
    if not ends or not sentences:
        return html
    begin = re.search(r"(?i)<(article|main)\b[^>]*>", html).end()
    inner = [m.end() for m in re.finditer(r"(?i)</p\s*>", html[begin : ends[0]])]
    places = [ends[0], ends[0] + re.match(r"[^>]*>", html[ends[0] :]).end()] + [begin + i for i in inner]
    for at in sorted((places[0 if k == 0 else rng.integers(len(places))] for k in range(4)), reverse=True):
        block = BLOCKS_AROUND[rng.integers(len(BLOCKS_AROUND))]
        forms = _LIST if block[:3] in ("<ul", "<ol") else _INNER[1:2] if block[:3] == "<p " else _INNER
        words = [sentences[i] for i in rng.integers(len(sentences), size=4)]
        words[2:] = [" ".join(w.split()[: rng.integers(1, 6)]) for w in words[2:]]
        content = forms[rng.integers(len(forms))].format(*words)
        cut = block.index("{}") - 1
        html = html[:at] + block[:cut] + f" role='{_NOISE}'" + block[cut:].format(content) + html[at:]
    return html


_SECTIONS = {"article", "main", "nav", "aside", "header", "footer"}


def _hidden(page: Page, rng) -> Page:
    """A copy in which sectioning elements are plain ones, and some lose their names too."""
    plain = [t in _SECTIONS and rng.random() < 0.7 for t in page.tag]
    return Page(["div" if q else t for t, q in zip(page.tag, plain, strict=True)], page.parent,
                ["" if q and rng.random() < 0.5 else n for n, q in zip(page.names, plain, strict=True)], page.text,
                page.linked)


def train(labelled: list[tuple[Page, np.ndarray]], *, ridge: float = 0.3, rounds: int = 12, seed: int = 1) -> Model:
    """Logistic regression for the unary part, smoothed counts for the tables."""
    rng = np.random.default_rng(seed)
    x, y, weight = [], [], []
    counts = np.full((N_PARENTS, 2, 2), 1.0)
    own = [_marked(h) for h in LABELLED]
    for pages, share in ((labelled, 1.0), (own, max(1.0, 0.5 * len(labelled) / len(own)))):
        for page, label in pages:
            for version in (page, page if pages is own else _hidden(page, rng)):
                f = features(version)
                x.append(f)
                y.append(label)
                weight.append(np.full(len(f), share))
                kinds = _kinds(version)
                for i in range(1, len(label)):
                    counts[kinds[version.parent[i]], int(label[version.parent[i]]), int(label[i])] += share
    x, y, weight = np.concatenate(x), np.concatenate(y), np.concatenate(weight)
    weight = weight / weight.mean()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
    # a table says how far the parent's kind and state change the child's state from what is common everywhere
    given = counts / counts.sum(axis=2, keepdims=True)
    base = counts.sum(axis=(0, 1)) / counts.sum()
    table = np.log(given / base)
    return Model(w, [tuple(float(v) for v in t.ravel()) for t in table])


def taught(pages: list[str], seed: int = 2) -> list[tuple[Page, np.ndarray]]:
    """Labelled pages from those that say what their article is, and copies with blocks around it."""
    rng = np.random.default_rng(seed)
    plain = [(page, label) for page in map(parse, pages) if (label := _sectioned(page)) is not None]
    sentences = [unescaped for page, label in plain for t, good in zip(page.text, label, strict=True) if t and good
                 for unescaped in [t.replace("&", "&amp;").replace("<", "&lt;").replace("{", "(").replace("}", ")")[:300]]]
    for html in pages:
        for _ in range(2):
            page = parse(_surrounded(html, sentences, rng))
            if (label := _sectioned(page)) is not None:
                page.names = [n.replace(_NOISE, "").strip() for n in page.names]
                plain.append((page, label))
    return plain


def fit(pages: DataFrame, *, html: str = "html", max_train: int = 300, max_chars: int = 50_000) -> Model:
    """Learn from ``LABELLED`` and at most ``max_train`` pages of the table of at most ``max_chars``, lowest hash first."""
    text = F.col(html)
    fit_ones = pages.select(text.alias("html"), F.xxhash64(text).alias("h")).where(
        text.rlike(r"(?i)<(article|main)[\s>]") & (F.length(text) <= max_chars)
    )
    # a share by hash first, so that ordering gets few pages from each partition
    share = min(1.0, 3.0 * max_train / max(1, fit_ones.count()))
    rows = fit_ones.where(F.pmod(F.xxhash64(F.lit(1), "h"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = rows.distinct().orderBy("h", "html").limit(max_train)
    return train(taught([r["html"] for r in rows.collect()]))


def extract(pages: DataFrame, model: Model, keep: list[str], *, html: str = "html") -> DataFrame:
    """The columns ``keep`` plus ``text`` and ``n_chars`` (code points) for every row of ``pages``."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # of fixed size
    kept = pages.select(*keep)
    names = kept.columns

    def run(batches):
        for batch in sliced(batches):
            texts = [main_text(shared.value, h) for h in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=[*names, "text", "n_chars"],
            )

    schema = kept.schema.add("text", "string").add("n_chars", "long")
    return pages.select(*keep, F.col(html).alias("_html")).mapInArrow(run, schema)
