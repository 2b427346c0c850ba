"""A web page as a tree of tokens: block elements and runs of text, without what the page itself marks as other than main text.

Marks are elements (menus, footers, forms ...), roles, and words in classes and ids. They are names that pages give to their own
parts; what no page says of itself is left to the wrapper of the host.
"""

from __future__ import annotations

import hashlib
import html as refs
import re

# Elements of HTML, and usual names of parts of pages.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title xmp svg math object select canvas audio video".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_OFF_TAGS = frozenset("head nav footer aside form dialog menu button label search".split())
_OFF_ROLES = frozenset("navigation contentinfo complementary search dialog alertdialog alert form menu menubar toolbar note".split())
_OFF_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion nav navbar navigation menu menubar footer sidebar aside cookie cookies consent gdpr notice "
    "alert popup modal overlay newsletter subscribe subscription signup signin login share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager comment comments "
    "commentlist disqus reply replies respond widget toolbar copyright banner".split()
)
_TOP_WORDS = frozenset("header masthead topbar".split())  # of the page, but not of an article
#: Of these words a name in an article may hold other ones besides: they mean the same wherever they stand.
_ALWAYS = frozenset("ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo newsletter breadcrumb breadcrumbs pagination disqus commentlist nav navbar sidebar footer cookie cookies consent gdpr".split())
#: Names of what holds a whole page: its other names tell what stands in it, not what it is.
_WHOLE = frozenset("layout page site app root".split())
_BUT = frozenset("has with no without".split())
_PARTS = frozenset("area articles bar block body box buttons container content form inner items link links list main outer pages posts section stories title top bottom widget wrap wrapper".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile("[0-9]+")
_raw_ends = {tag: re.compile(rf"</{tag}(?:[\s/][^>]*)?>", re.I) for tag in sorted(_RAW)}

TEXT = "#"
_known: dict[tuple[int, str], int] = {}


def below(parent: int, sig: str) -> int:
    """What a token of this signature under that place is called: a 64-bit hash of all signatures on the way to it."""
    found = _known.get((parent, sig))
    if found is None:
        if len(_known) > 1 << 16:
            _known.clear()
        found = _known[parent, sig] = int.from_bytes(hashlib.blake2b(f"{parent}/{sig}".encode(), digest_size=8).digest(), "big", signed=True)
    return found


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTR.finditer(text)} if text.strip(" /") else {}


def _off(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether an element is marked as something other than main text.

    In an article, labels and headings are text whatever they are called, and a name such as share-price counts only if all its
    words are names of parts of pages. Outside, names beside one for the whole page, such as ``layout sidebar-left``, don't count.
    """
    if tag in ("html", "body", "main", "article"):
        return False
    if (tag in _OFF_TAGS and not (in_article and tag == "label")) or (tag == "header" and not in_article):
        return True
    if not attrs:
        return False
    role = attrs.get("role", "").lower()
    if role in _OFF_ROLES or (role == "banner" and not in_article) or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    names, ids = attrs.get("class", "").split(), attrs.get("id", "").split()
    if in_article:
        if tag in _HEADINGS:  # ids there are also anchors made of headings, such as related-work
            return False
        known = lambda x: all(y in _OFF_WORDS | _TOP_WORDS | _PARTS or len(y) < 3 for y in x)
    else:
        if not _WHOLE.isdisjoint(x.lower() for x in names):
            return False
        known = lambda x: True
    for name, is_id in [*((x, False) for x in names), *((x, True) for x in ids)]:
        parts = [x.lower() for x in _PART.findall(name)]
        for k, x in enumerate(parts):
            if x in _BUT:
                break
            if (x in _OFF_WORDS or (x in _TOP_WORDS and not in_article)) and (known(parts) or (x in _ALWAYS and not is_id)):
                return True
    return False


class Page:
    """Tokens in page order: ``up`` (index of the parent or -1), ``ctx`` (its place by signatures), ``nth`` (among its parent's
    tokens of this signature); and for each run of text its token, the text, whether it is in an article, whether it is mostly links.
    """

    def __init__(self, source: str | None) -> None:
        self.up: list[int] = []
        self.ctx: list[int] = []
        self.nth: list[int] = []
        self.sig: list[str] = []
        self.leaf: list[int] = []
        self.text: list[str] = []
        self.main: list[bool] = []
        self.link: list[bool] = []
        self.many: dict[tuple[int, int], int] = {}  # (parent, ctx) -> tokens
        self._held: list[str] = []
        self._linked = self._links = 0
        # tag, in article, off, token, block
        self._open: list[tuple[str, bool, bool, int, bool]] = [("", False, False, -1, True)]
        self._names: dict[str, int] = {}
        self._run(source or "")

    def _token(self, parent: int, sig: str) -> int:
        ctx = below(self.ctx[parent] if parent >= 0 else 0, sig)
        n = self.many[parent, ctx] = self.many.get((parent, ctx), 0) + 1
        self.up.append(parent), self.ctx.append(ctx), self.nth.append(n), self.sig.append(sig)
        return len(self.up) - 1

    def _flush(self) -> None:
        if not self._held:
            return
        raw = "".join(self._held)
        text = " ".join(refs.unescape(raw).split())
        linked, self._linked = self._linked, 0
        self._held.clear()
        _, article, off, token, _ = self._open[-1]
        if text and not off:
            self.leaf.append(self._token(token, TEXT))
            self.text.append(text), self.main.append(article), self.link.append(2 * linked > len(raw))

    def _say(self, piece: str) -> None:
        self._held.append(piece)
        if self._links:
            self._linked += len(piece)

    def _push(self, entry: tuple[str, bool, bool, int, bool]) -> None:
        self._open.append(entry)
        self._names[entry[0]] = self._names.get(entry[0], 0) + 1
        self._links += entry[0] == "a"

    def _close(self, tags: set[str], within: bool) -> None:
        """Close the innermost open element of ``tags``; ``within``: only up to the nearest other block."""
        if not any(self._names.get(x) for x in tags):
            return
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k][0] in tags:
                if any(self._open[j][4] for j in range(k, len(self._open))):
                    self._flush()
                for tag, *_ in self._open[k:]:
                    self._names[tag] -= 1
                    self._links -= tag == "a"
                del self._open[k:]
                return
            if within and self._open[k][4] and self._open[k][0] != "p":
                return

    def _run(self, s: str) -> None:
        at, end = 0, len(s)
        while at < end:
            m = _TAG.search(s, at)
            if not m:
                self._say(s[at:])
                break
            if m.start() > at:
                self._say(s[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                if tag in _BLOCK:
                    self._flush()
                self._close({tag}, False)
                continue
            attrs = _attributes(m[3] or m[6] or "")
            if tag in _RAW:
                if not (m[3] or m[6] or "").rstrip().endswith("/"):
                    gone = _raw_ends[tag].search(s, at)
                    at = gone.end() if gone else end
                continue
            if tag == "br":
                self._held.append(" ")
            block = tag in _BLOCK
            if block:
                self._flush()
                self._close({"p"}, True)
                if tag in _CLOSES:
                    self._close(_CLOSES[tag], True)
            if tag in _VOID:
                continue
            _, article, was_off, parent, _ = self._open[-1]
            off = was_off or _off(tag, attrs, article)
            if off and not was_off:
                self._flush()  # what follows isn't part of the text before
                block = True
            article = article or tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article")
            if block and not off:
                classes = sorted({_DIGITS.sub("0", x) for x in attrs["class"].split()}) if "class" in attrs else ()
                parent = self._token(parent, ".".join([tag, *classes]))
            self._push((tag, article, off, parent, block))
        self._flush()

    def places(self) -> list[tuple[int, int, str, int, int, int, int, int, list[int], bool]]:
        """How the tokens of each place stand under their parents: (place, parent's place, signature, least and most tokens in a
        parent that has any, tokens, parents that have any, first position, places just before it, 0 for none, ends a parent)."""
        of: dict[int, list] = {}
        last: dict[int, tuple[int, int]] = {}  # parent -> its latest token's place and position
        for up, ctx, sig in zip(self.up, self.ctx, self.sig, strict=True):
            before, k = last.get(up, (0, -1))
            x = of.get(ctx)
            if x is None:
                x = of[ctx] = [self.ctx[up] if up >= 0 else 0, sig, 0, 0, 0, 0, k + 1, set(), False]
            x[4] += 1
            x[6] = min(x[6], k + 1)
            x[7].add(before)
            last[up] = ctx, k + 1
        for ctx, _ in last.values():
            of[ctx][8] = True
        for (_, ctx), n in self.many.items():
            x = of[ctx]
            x[2], x[3], x[5] = min(x[2] or n, n), max(x[3], n), x[5] + 1
        return [(ctx, *x[:7], sorted(x[7]), x[8]) for ctx, x in of.items()]
