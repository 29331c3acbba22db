"""Made-up web pages with known main text, which the extraction model learns from."""

from __future__ import annotations

import random
from html import escape

#: How pages name their parts.
NAMES = {
    "main": "content main article post entry story body text page-content post-content entry-content article-body story-text main-content blog-post single td-post-content c-article__body prose",
    "nav": "nav navbar navigation menu main-menu topnav breadcrumb breadcrumbs site-nav nav-links tabs pagination toc-nav menu-item skip-links",
    "header": "header site-header masthead top-bar branding logo page-header banner-top",
    "footer": "footer site-footer page-footer copyright colophon bottom-bar footer-links legal",
    "side": "sidebar side aside widget widget-area rail right-column related related-posts recent-posts popular trending more-stories tags tag-cloud recommended author-box",
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion banner dfp adsense ad-slot outbrain taboola commercial",
    "notice": "notice cookie cookie-banner cookies consent gdpr alert popup modal overlay newsletter subscribe paywall warning-bar message toast disclaimer",
    "form": "search search-form login signup contact-form subscribe-form form field",
    "comments": "comments comment comment-list commentlist disqus discussion replies reply respond reader-comments responses user-comments comment-body feedback",
    "share": "share social social-links sharing share-buttons meta byline tools print",
}
NAMES = {k: v.split() for k, v in NAMES.items()}
SYLLABLES = "an be con der en fa gi ho in ka lo mi ne or pa que ra su ti un ve wa za tion schu eau lich ado ing".split()


class Maker:
    """Pages by a seed; that share of them, strange, has made-up words for the names of its parts, which tell nothing."""

    def __init__(self, seed: int, strange: float = 0.2):
        self.r, self.strange, self.names = random.Random(seed), strange, NAMES

    def words(self, n: int) -> str:
        return " ".join("".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 3))) for _ in range(n))

    def sentences(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            s = self.words(self.r.randint(2, 16)).capitalize()
            out.append((s.replace(" ", ", ", 1) if self.r.random() < 0.4 else s) + ".")
        return " ".join(out)

    def named(self, kind: str, tag: str | None = None) -> tuple[str, str]:
        """A start tag that may be named by what it is, or not at all."""
        r = self.r
        attrs = ""
        if r.random() < 0.8:
            names = " ".join(r.sample(self.names[kind], r.choice((1, 1, 2))))
            attrs = f' {r.choice(("class", "class", "class", "id"))}="{names}"'
        tag = tag or r.choice(("div", "div", "section"))
        if not attrs and tag in ("div", "section") and kind != "main":
            attrs = f' class="{r.choice(self.names[kind])}"'
        return f"<{tag}{attrs}>", f"</{tag}>"

    def links(self, kind: str, tag: str | None = None) -> str:
        r, (a, b) = self.r, self.named(kind, tag)
        n = r.randint(2, 12)
        items = [f'<a href="/{i}">{self.words(r.randint(1, 5))}</a>' for i in range(n)]
        if r.random() < 0.75:
            return f"{a}<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>{b}"
        return a + r.choice((" ", " | ", "")).join(items) + b

    def boilerplate(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return self.links("nav", r.choice(("nav", "div")))
        if kind == "header":
            a, b = self.named("header", r.choice(("header", "header", "div")))
            return a + r.choice((f"<h1><a href='/'>{self.words(2)}</a></h1>", f"<div>{self.words(2)}</div>", f"<p>{self.words(4)}</p>")) + (self.links("nav") if r.random() < 0.5 else "") + b
        if kind == "footer":
            a, b = self.named("footer", r.choice(("footer", "footer", "div")))
            return a + r.choice((f"&copy; {self.words(2)} &middot; {self.sentences(1, 4)}", f"<p>{self.sentences(1, 3)}</p>", self.links("footer"))) + b
        if kind == "side":
            a, b = self.named("side", r.choice(("aside", "aside", "div")))
            return a + f"<h3>{self.words(2)}</h3>" + r.choice((self.links("side"), f"<p>{self.sentences(1, 5)}</p>", f"<p>{self.sentences(1, 2)}</p><p>{self.sentences(1, 3)}</p>")) + b
        if kind == "ad":
            a, b = self.named("ad", r.choice(("div", "div", "section", "aside", "p")))
            return a + r.choice((self.sentences(1, 4), f"<a href='/x'>{self.sentences(1, 2)}</a>", self.words(3))) + b if "<p" in a else a + r.choice((self.sentences(1, 5), f"<p>{self.sentences(1, 4)}</p>", f"<a href='/x'>{self.sentences(1, 2)}</a>")) + b
        if kind == "notice":
            a, b = self.named("notice", r.choice(("div", "div", "section", "aside", "dialog")))
            return a + r.choice((self.sentences(1, 4), f"<p>{self.sentences(1, 5)}</p><button>ok</button>", f"<h2>{self.words(3)}</h2><p>{self.sentences(1, 2)}</p>")) + b
        if kind == "form":
            a, b = self.named("form", "form" if r.random() < 0.8 else None)
            return a + f"<label>{self.words(2)}</label><input name=q>" + r.choice(("", f"<p>{self.sentences(1, 3)}</p>", f"<fieldset><legend>{self.words(2)}</legend><div>{self.words(3)}</div></fieldset>")) + "<button>go</button>" + b
        if kind == "comments":
            a, b = self.named("comments", r.choice(("div", "div", "section", "ol")))
            each = []
            for _ in range(r.randint(1, 6)):
                body = r.choice((f"<p>{self.sentences(1, 6)}</p>", f"<div>{self.sentences(1, 4)}</div>", f"<p>{self.sentences(1, 3)}</p><p>{self.sentences(1, 4)}</p>"))
                x, y = self.named("comments", "li" if "<ol" in a else r.choice(("div", "article", "div")))
                each.append(x + r.choice(("", f"<div class='author'><a href='/u'>{self.words(1)}</a></div>", f"<b>{self.words(2)}</b>")) + body + y)
            return a + (f"<h3>{self.words(2)}</h3>" if r.random() < 0.6 and "<ol" not in a else "") + "".join(each) + b
        return self.links("share", "div")

    def main_part(self) -> str:
        """One piece of main text; the strings \\1 and \\2 mark where it begins and ends."""
        r = self.r
        x = r.random()

        def mark(s: str) -> str:
            return f"\1{s}\2"

        if x < 0.6:
            s = self.sentences(1, r.choice((2, 6, 12))) if r.random() < 0.7 else self.words(r.randint(1, 4)).capitalize() + "."
            if r.random() < 0.3:
                s += f" <a href='/y'>{self.words(2)}</a> <b>{self.words(2)}</b> {self.words(3)}."
            return f"<p>{mark(s)}" + ("</p>" if r.random() < 0.9 else "")
        if x < 0.7:
            return f"<h{(n := r.randint(2, 4))}>{mark(self.words(r.randint(1, 7)))}</h{n}>"
        if x < 0.8:
            return "<ul>" + "".join(f"<li>{mark(self.sentences(1, 2))}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if x < 0.86:
            return f"<blockquote><p>{mark(self.sentences(1, 3))}</p></blockquote>"
        if x < 0.9:
            return "<table>" + "".join(f"<tr><td>{mark(self.words(2))}</td><td>{mark(self.words(1))}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if x < 0.94:
            return f"<pre>{mark(self.words(9))}</pre>"
        if x < 0.97:
            return f"<figure><img src=x><figcaption>{mark(self.words(6))}</figcaption></figure>"
        return f"<div>{mark(self.sentences(1, 5))}</div>"

    def page(self) -> str:
        """Main text lies between \\1 and \\2."""
        r = self.r
        self.names = {k: [f"{self.words(1)}-{self.words(1)}" for _ in range(6)] for k in NAMES} if r.random() < self.strange else NAMES
        if r.random() < 0.04:
            return f"<html><body>\1{escape(self.sentences(1, 8))}\2</body></html>" if r.random() < 0.5 else f"\1{self.sentences(1, 5)}\2"
        title = self.sentences(1, 2)
        parts = [f"<h1>\1{title}\2</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice((0, 1, 2, 4, 8, 14)) or r.randint(0, 1)):
            parts.append(self.main_part())
            if r.random() < 0.12:
                parts.append(self.boilerplate(r.choice(("ad", "ad", "side", "form", "notice", "share"))))
        tag = r.choice(("article", "article", "main", "div", "div", "section"))
        a, b = self.named("main", tag)
        if r.random() < 0.4 and tag in ("article", "main"):
            a = f"<{tag}>"
        main = a + "".join(parts) + b
        if r.random() < 0.3:
            x, y = self.named("main", r.choice(("main", "div")))
            main = x + (self.boilerplate("nav") if r.random() < 0.2 else "") + main + (self.boilerplate("comments") if r.random() < 0.4 else "") + y
        before = [k for k in ("header", "nav", "ad", "notice", "form", "nav") if r.random() < 0.5]
        after = [k for k in ("side", "comments", "ad", "share", "form", "notice") if r.random() < 0.4] + (["footer"] if r.random() < 0.85 else [])
        side = [self.boilerplate("side")] if r.random() < 0.3 else []
        r.shuffle(before)
        body = "".join(map(self.boilerplate, before)) + ("".join(side) if r.random() < 0.5 else "") + main + "".join(map(self.boilerplate, after))
        if r.random() < 0.3:
            body = f'<div id="{r.choice(("page", "wrapper", "container", "root", "app"))}">{body}</div>'
        head = f"<head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{body}</body></html>"
