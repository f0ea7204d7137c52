"""Made-up pages with known main text, to train and test the block labeller of operator 10."""

from __future__ import annotations

import re

import numpy as np

#: Names that sites give to parts of their pages.
NAMES = {
    "menu": "menu nav navbar navigation main-menu site-nav topnav breadcrumb breadcrumbs tabs links toc pagination pager",
    "header": "header site-header masthead page-header top topbar branding logo banner hero-bar",
    "footer": "footer site-footer page-footer bottom colophon copyright legal",
    "sidebar": "sidebar side aside rail widget widgets widget-area secondary related related-posts recommended trending popular tags archive",
    "notice": "notice cookie cookies cookie-banner consent gdpr alert message popup modal overlay newsletter subscribe paywall disclaimer",
    "advert": "ad ads advert advertisement adbox ad-slot ad-banner sponsored sponsor promo promotion banner-ad dfp",
    "form": "form search search-form login signup contact-form subscribe-form feedback",
    "comment": "comment comments comment-list commentlist replies reply discussion respond reader-comments responses disqus thread",
    "share": "share social social-links share-buttons follow",
    "article": "article post content entry entry-content post-content article-body story story-body main main-content text body-text page-content single hentry prose",
    "neutral": "container wrapper inner row col column box block section grid layout wrap outer site page clearfix",
}
NAMES = {k: v.split() for k, v in NAMES.items()}
#: Words that parts of pages often have.
SAYS = {
    "menu": "Home About Contact News Products Services Blog Help Login Archive Shop Next Previous",
    "footer": "Copyright reserved rights Privacy Terms Imprint Contact Sitemap",
    "notice": "We use cookies accept agree privacy subscribe newsletter continue",
    "advert": "Buy now offer sale free discount sponsored click here",
    "form": "Search Name Email Send Submit Password Login Message",
    "comment": "says wrote Reply commented ago great thanks post agree",
    "share": "Share Tweet Facebook Print Email Follow",
    "sidebar": "Related Popular Recent Tags Archive Categories More",
    "header": "Welcome daily site",
}
SAYS = {k: v.split() for k, v in SAYS.items()}
SYLLABLES = "the on er an re ti es ou ing ble th in at ed nd ha to or ea is al en la de ción que mente ar os as do ta ll un che schen ver be ge ung keit eau eux aire men tion lo mi".split()
MARKS = "§¶"


class Page:
    def __init__(self, rng: np.random.Generator):
        self.r, self.wanted, self.n = rng, [], 0
        self.semantic, self.named = rng.random() < 0.6, rng.random() < 0.9

    def odds(self, p: float) -> bool:
        return self.r.random() < p

    def pick(self, xs):
        return xs[int(self.r.integers(len(xs)))]

    def word(self) -> str:
        return "".join(self.pick(SYLLABLES) for _ in range(int(self.r.integers(1, 4))))

    def words(self, low: int, high: int, role: str = "") -> str:
        out = [self.pick(SAYS[role]) if role in SAYS and self.odds(0.3) else self.word() for _ in range(int(self.r.integers(low, high + 1)))]
        text = " ".join(out)
        if self.odds(0.7):
            text = text[:1].upper() + text[1:] + self.pick([".", ".", "", "!", "?"])
        return text

    def prose(self) -> str:
        text = " ".join(self.words(2, 25) for _ in range(int(self.r.integers(1, 5 if self.odds(0.8) else 14))))
        if self.odds(0.12):  # lists and tables in one line, codes and numbers
            mark = self.pick([" | ", " | ", " · ", " / ", " ; ", " 12.5 ", " # "])
            text = mark.join(self.pick([self.word(), self.word().capitalize(), str(self.r.integers(9999))]) for _ in range(int(self.r.integers(2, 40))))
        for tag in ("b", "em", "a href='/x'", "span", "code"):
            if self.odds(0.08):
                a, *rest = text.split(" ", 1)
                text = f"<{tag}>{a}</{tag.split()[0]}> {rest[0] if rest else ''}"
        return text.replace(" ", "<br>", 1) if self.odds(0.05) and "<" not in text else text

    def mark(self) -> str:
        """A sign of wanted text, that trained features don't see as a word of its own."""
        self.n += 1
        mark = f"{MARKS[0]}{self.n}{MARKS[1]}"
        self.wanted.append(mark)
        return mark

    def names(self, role: str) -> str:
        kinds = []
        if role == "neutral" and self.odds(0.5) or not self.named and role != "neutral" and self.odds(0.5):
            kinds.append(f"c{self.r.integers(99)}")
        else:
            kinds.append(self.pick(NAMES[role]))
        if self.odds(0.2):
            kinds.append(self.pick(NAMES["neutral"]))
        return f' {self.pick(["class", "class", "id"])}="{" ".join(kinds)}"'

    def wrap(self, role: str, tag: str, body: str) -> str:
        """In the tag that HTML has for it, or a named ``div``."""
        if tag != "div" and (self.semantic or self.odds(0.3)):
            return f"<{tag}{self.names(role) if self.odds(0.3) else ''}>{body}</{tag}>"
        tag = self.pick(["div", "div", "section"])
        return f"<{tag}{self.names(role)}>{body}</{tag}>"

    def items(self, role: str, low: int = 2, high: int = 9) -> str:
        one = [f"<li><a href='/{k}'>{self.words(1, 3, role)}</a></li>" if self.odds(0.85) else f"<li>{self.words(1, 4, role)}</li>" for k in range(int(self.r.integers(low, high)))]
        return f"<{(t := self.pick(['ul', 'ul', 'ol']))}>{''.join(one)}</{t}>" if self.odds(0.8) else " ".join(f"<a href='/{k}'>{self.words(1, 3, role)}</a>" for k in range(4))

    def menu(self) -> str:
        return self.wrap("menu", "nav", self.items("menu"))

    def header(self) -> str:
        body = f"<{(t := self.pick(['h1', 'h2', 'p', 'div', 'a']))}>{self.words(1, 5, 'header')}</{t}>"
        return self.wrap("header", "header", body + (self.menu() if self.odds(0.5) else "") + (f"<p>{self.words(2, 9)}</p>" if self.odds(0.4) else ""))

    def footer(self) -> str:
        body = self.pick(["&copy; ", "", "Copyright ", "&#169; 2024 "]) + self.words(2, 12, "footer") + self.pick(["", " &middot; " + self.words(2, 9)])
        return self.wrap("footer", "footer", (f"<p>{body}</p>" if self.odds(0.5) else body) + (self.items("footer") if self.odds(0.4) else "") + (f"<p>{self.prose()}</p>" if self.odds(0.2) else ""))

    def sidebar(self) -> str:
        body = f"<h3>{self.words(1, 4, 'sidebar')}</h3>" * self.odds(0.6) + self.items("sidebar") * self.odds(0.7) + "".join(f"<p>{self.prose()}</p>" for _ in range(int(self.r.integers(0, 3))))
        return self.wrap("sidebar", "aside", body or self.words(3, 20))

    def boxed(self, role: str, tag: str = "div") -> str:
        text = self.pick([self.words(2, 12, role), self.words(8, 40, role), self.prose()])
        return self.wrap(role, tag, f"<p>{text}</p>" * (inside := self.odds(0.5)) + (not inside) * text + f"<a href='/x'>{self.words(1, 3, role)}</a>" * self.odds(0.3) + f"<button>{self.words(1, 2, role)}</button>" * self.odds(0.2 if role == "notice" else 0))

    def form(self) -> str:
        rows = "".join(self.pick([f"<label>{self.words(1, 3, 'form')}</label><input name='q'>", f"<p>{self.words(2, 9, 'form')}</p>", f"<select><option>{self.word()}</option><option>{self.word()}</option></select>", f"<textarea>{self.word()}</textarea>"]) for _ in range(int(self.r.integers(1, 5))))
        return f"<form action='/s'{self.names('form') if self.odds(0.5) else ''}>{rows}<button>{self.words(1, 2, 'form')}</button></form>"

    def comments(self) -> str:
        def one() -> str:
            text = "".join(f"<p>{self.prose()}</p>" for _ in range(int(self.r.integers(1, 3)))) if self.odds(0.7) else self.prose()
            by = f"<{(t := self.pick(['b', 'span', 'cite', 'h4', 'div']))}>{self.words(1, 3, 'comment')}</{t}>" * self.odds(0.6)
            return f"<{(t := self.pick(['div', 'li', 'article', 'section']))}{self.names('comment')}>{by}{text}</{t}>"

        head = f"<h{(k := self.pick([2, 3, 4]))}>{self.words(1, 4, 'comment')}</h{k}>" * self.odds(0.7)
        body = head + "".join(one() for _ in range(int(self.r.integers(1, 6)))) + self.form() * self.odds(0.3)
        return f"<{(t := self.pick(['section', 'div', 'ol', 'ul', 'aside']))}{self.names('comment')}>{body}</{t}>"

    def article(self) -> str:
        out = [f"<h1>{self.mark()}{self.words(2, 12)}</h1>"] if self.odds(0.85) else []
        for _ in range(int(self.r.integers(1, 4 if self.odds(0.25) else 16))):
            k, mark = self.r.random(), self.mark
            if k < 0.70:
                out.append(f"<p>{mark()}{self.pick([self.prose, self.prose, lambda: self.words(1, 8)])()}</p>")
            elif k < 0.74:
                out.append(f"<p><b>{mark()}{self.prose()}<br>")
            elif k < 0.80:
                out.append(f"<h{(n := self.pick([2, 2, 3, 4]))}>{mark()}{self.words(1, 8)}</h{n}>")
            elif k < 0.85:
                out.append(f"<{(t := self.pick(['ul', 'ol']))}>" + "".join(f"<li>{mark()}{self.words(1, 15)}</li>" for _ in range(int(self.r.integers(2, 6)))) + f"</{t}>")
            elif k < 0.88:
                out.append(f"<blockquote>{mark()}{self.prose()}</blockquote>")
            elif k < 0.90:
                out.append("<table>" + "".join("<tr>" + "".join(f"<{(c := self.pick(['td', 'td', 'th']))}>{mark()}{self.words(1, 4)}</{c}>" for _ in range(2)) + "</tr>" for _ in range(3)) + "</table>")
            elif k < 0.92:
                out.append(self.pick([f"<pre>{mark()}{self.words(3, 20)}</pre>", f"<figure><img src='x'><figcaption>{mark()}{self.words(2, 12)}</figcaption></figure>", f"<div>{mark()}{self.prose()}</div>", f"<dl><dt>{mark()}{self.words(1, 3)}</dt><dd>{mark()}{self.words(2, 12)}</dd></dl>"]))
            elif k < 0.97:
                out.append(self.boxed("advert", self.pick(["div", "aside"])) if self.odds(0.6) else self.boxed(self.pick(["share", "sidebar", "notice"]), self.pick(["div", "aside"])))
            else:
                out.append("<script>var x='</p>';</script>")
        body = "".join(out)
        k = self.r.random()
        if k < 0.5:
            return f"<article{self.names('article') if self.odds(0.3) else ''}>{body}</article>"
        if k < 0.65:
            return f"<main>{body}</main>"
        if k < 0.92:
            return f"<{(t := self.pick(['div', 'div', 'section']))}{self.names('article')}>{body}</{t}>"
        return f"<div>{body}</div>" if self.odds(0.5) else body

    def html(self) -> str:
        if self.odds(0.01):
            return self.mark() + self.prose()
        top = [self.pick([self.menu, self.menu, self.header, self.header, lambda: self.boxed("notice"), lambda: self.boxed("advert"), self.form, self.sidebar])() for _ in range(int(self.r.integers(0, 5)))]
        end = [self.pick([self.sidebar, self.sidebar, self.comments, self.comments, lambda: self.boxed("advert"), lambda: self.boxed("notice"), lambda: self.boxed("share"), self.form, self.menu])() for _ in range(int(self.r.integers(0, 5)))]
        body = "".join([*top, self.article(), *end, self.footer() if self.odds(0.85) else ""])
        if self.odds(0.3):
            body = f"<div{self.names('neutral')}>{body}</div>"
        if self.odds(0.1):
            body = body[: int(len(body) * self.r.uniform(0.5, 1))]
        head = f"<head><meta charset='utf-8'><title>{self.words(1, 8)}</title><style>p{{margin:0}}</style></head>" * self.odds(0.9)
        return f"<!DOCTYPE html><html>{head}<body{self.names('neutral') * self.odds(0.1)}>{body}"


def page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A page, and the marks of which each wanted block has one; ``unmarked`` takes them out again."""
    p = Page(rng)
    return p.html(), p.wanted


def unmarked(text: str) -> str:
    return re.sub(f"{MARKS[0]}[0-9]+{MARKS[1]}", "", text)
