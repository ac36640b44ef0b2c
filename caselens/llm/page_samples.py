"""Labelled web pages to train and to test the page model on: invented words in many layouts.

A page is put together from an article and parts that are not of it (menus, page headers and footers, sidebars,
notices, adverts, forms, reader comments). Every piece of the article's text begins with MARK, so a parser that
sees the mark knows the label of the text around it.
"""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

MARK = "\ue000"
SYLLABLES = "ka lo mi ter an ou re shi ble nd que ção é ü der ing st om pra ver nu tal wi sor".split()
# Words that also occur outside articles.
ARTICLE_CUES = ("© 1999", "copyright", "cookies", "privacy", "subscribe", "search", "comments", "reply", "sponsored", "a comment,")
# Class or id names by kind of part, as sites write them.
NAMES = {
    "nav": "nav menu main-menu navbar topnav navigation breadcrumb breadcrumbs pagination pager tabs leftnav",
    "header": "header site-header masthead topbar banner page-header branding",
    "footer": "footer site-footer page-footer copyright colophon bottom-footer legal",
    "side": "sidebar side-bar widget related related-posts popular trending aside right-column recommended widget-area",
    "notice": "cookie-notice cookies consent gdpr-banner notice alert popup modal site-notice announcement cookieBar",
    "ad": "ad ads advert advertisement sponsored promo adbox ad-slot banner-ad adsbygoogle sponsor",
    "form": "search search-form login newsletter subscribe signup contact-form searchBox register",
    "comments": "comments comment-list discussion reader-comments responses disqus commentArea replies",
    "share": "share social share-buttons social-links follow",
    "main": "content article post entry story main main-content article-body post-content entry-content text page-content",
}
PLAIN_WRAPS = "wrapper container row col inner box block outer layout grid section-1 clearfix".split()
TAG_OF = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comments": "section", "main": "article"}
ROLE_OF = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "side": "complementary", "form": "search", "notice": "alert", "main": "main"}


class _Page:
    def __init__(self, rnd: random.Random):
        self.rnd = rnd
        # How this page tells its parts apart: by tags, names, roles, a table, or not at all.
        self.style = rnd.choices(["tags", "names", "roles", "table", "bare"], [4, 5, 1.5, 1.5, 2])[0]
        self.noisy = rnd.random() < 0.2
        # Where the markup tells the parts apart, the shape of the text need not: short articles, long notices.
        told = self.style in ("tags", "names", "roles")
        self.terse, self.wordy = told and rnd.random() < 0.35, told and rnd.random() < 0.35

    def words(self, least: int, most: int) -> str:
        r = self.rnd
        out = ["".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(least, most))]
        if self.noisy:
            out = [w + r.choice(["", "###", "&", "$$$", ",", "***"]) for w in out]
        return " ".join(out)

    def sentences(self, n: int, least: int = 4, most: int = 25) -> str:
        out = []
        for _ in range(n):
            s = self.words(least, most).capitalize()
            if self.rnd.random() < 0.5:
                s = s.replace(" ", ", ", self.rnd.randint(1, 2))
            out.append(s + self.rnd.choices([".", "?", "!", ""], [20, 1, 1, 1])[0])
        return " ".join(out)

    def name(self, kind: str, tag: str | None = None) -> tuple[str, str]:
        """The tag of a part and its attributes."""
        r = self.rnd
        names = r.choice(NAMES[kind].split())
        attribute = f' {r.choice(["class", "class", "id"])}="{names}"'
        if self.style == "tags" and kind in TAG_OF and r.random() < (0.9 if kind == "main" else 0.65):
            return tag or TAG_OF[kind], attribute if r.random() < 0.4 else ""
        if self.style == "roles" and kind in ROLE_OF:
            return "div", f' role="{ROLE_OF[kind]}"'
        bare = self.style == "bare" or (self.style == "table" and r.random() < 0.6)
        if bare and kind not in ("ad", "notice", "comments") or r.random() < 0.05:
            return tag or "div", ""
        return "form" if kind == "form" and r.random() < 0.7 else "div", attribute

    def part(self, kind: str, inner: str, tag: str | None = None) -> str:
        tag, attributes = self.name(kind, tag)
        if tag == "div" and inner.startswith("<ul>") and inner.endswith("</ul>") and inner.count("<ul>") == 1:
            out = f"<ul{attributes}>{inner[4:]}"
        else:
            out = f"<{tag}{attributes}>{inner}</{tag}>"
        while self.rnd.random() < 0.15:
            out = f'<div class="{self.rnd.choice(PLAIN_WRAPS)}">{out}</div>'
        return out

    def links(self, least: int, most: int, size: int = 3) -> str:
        r = self.rnd
        plain = r.random() < 0.12
        items = [html.escape(self.words(1, size)) for _ in range(r.randint(least, most))]
        items = [i if plain else f'<a href="/{k}">{i}</a>' for k, i in enumerate(items)]
        form = r.random()
        if form < 0.65:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        if form < 0.8:
            return r.choice([" | ", " &gt; ", " "]).join(items)
        return "<br>".join(items) if form < 0.9 else "".join(f"<div>{i}</div>" for i in items)

    # --- parts that are not of the article
    def prose(self, most: int) -> str:
        text = html.escape(self.sentences(self.rnd.randint(3, 7)) if self.wordy else self.sentences(self.rnd.randint(1, most), 2, 18))
        return text if self.rnd.random() < 0.6 else f"<p>{text}</p>"

    def menu(self) -> str:
        return self.part("nav", self.links(3, 12))

    def page_header(self) -> str:
        r = self.rnd
        title = html.escape(self.words(1, 5))
        inner = r.choice([f'<a href="/">{title}</a>', f"<h1>{title}</h1>", f"<p>{title}</p>", title])
        if r.random() < 0.5:
            inner += f"<p>{html.escape(self.sentences(1, 3, 12))}</p>"
        return self.part("header", inner + (self.menu() if r.random() < 0.4 else "") + (self.search() if r.random() < 0.3 else ""))

    def page_footer(self) -> str:
        r = self.rnd
        legal = r.choice(["&copy; 2021 ", "© ", "Copyright ", "All rights reserved. ", ""])
        inner = r.choice(["", "<p>"]) + legal + html.escape(self.words(1, 4)) + r.choice([" &middot; ", ". ", " | "]) + html.escape(self.sentences(r.randint(1, 3)))
        return self.part("footer", inner + (self.links(2, 8) if r.random() < 0.6 else ""))

    def sidebar(self) -> str:
        r = self.rnd
        heading = f"<h{r.randint(2, 4)}>{html.escape(self.words(1, 4))}</h3>" if r.random() < 0.6 else ""
        body = self.links(3, 10, 9) if r.random() < 0.6 else self.prose(4) + (self.links(0, 4, 6) if r.random() < 0.5 else "")
        return self.part("side", heading + body)

    def notice(self) -> str:
        r = self.rnd
        cue = r.choice(["This site uses cookies. ", "We value your privacy. ", "", "", ""])
        return self.part("notice", f"{cue}{self.prose(3)}" + r.choice(["<button>OK</button>", "<a href='#'>Accept</a>", ""]))

    def advert(self) -> str:
        cue = self.rnd.choice(["Advertisement ", "Sponsored: ", "", "", "", ""])
        return self.part("ad", cue + self.prose(3) + self.rnd.choice(["", "<a href='/buy'>" + self.words(1, 4) + "</a>"]))

    def search(self) -> str:
        r = self.rnd
        cue = r.choice(["Search ", "Subscribe to ", "Log in", "Sign up for our newsletter ", "", "", ""])
        label = f"<label>{cue}{html.escape(self.words(1, 4))}</label>" if r.random() < 0.8 else ""
        more = r.choice(["<p>", ""]) + cue + self.prose(2) if r.random() < 0.7 else ""
        return self.part("form", f'{more}{label}<input type="text"><select><option>{self.words(1, 2)}</option></select><button>{self.words(1, 2)}</button>')

    def share(self) -> str:
        return self.part("share", self.rnd.choice(["Share: ", ""]) + self.links(2, 5, 1))

    def comments(self) -> str:
        r = self.rnd
        heading = f"<h3>{r.choice(['Comments', '3 comments', html.escape(self.words(1, 2))])}</h3>" if r.random() < 0.6 else ""
        out = []
        for _ in range(r.randint(1, 6)):
            who = f"<{r.choice(['b', 'cite', 'span'])} class=author>{self.words(1, 2)}</b>" if r.random() < 0.6 else ""
            text = html.escape(self.sentences(r.randint(1, 5)))
            kind = r.choice(["<p>{}</p>", "{}", "<div class=comment-body><p>{}</p></div>", "<div class='comment-content'>{}</div>"])
            reply = "<a href='#'>Reply</a>" if r.random() < 0.4 else ""
            holder = r.choice(["div class=comment", "li", "div", "article class=comment"])
            out.append(f"<{holder}>{who}{kind.format(text)}{reply}</{holder.split()[0]}>")
        return self.part("comments", heading + "".join(out))

    # --- the article
    def mine(self, text: str) -> str:
        if self.rnd.random() < 0.05:
            text = f"{self.rnd.choice(ARTICLE_CUES)} {text}"
        return MARK + html.escape(text)

    def paragraph(self) -> str:
        r = self.rnd
        n = r.choices([0, 1, 2, 4, 9], [6, 3, 1, 0, 0] if self.terse else [2, 5, 5, 5, 2])[0]
        text = self.sentences(n) if n else self.words(1, 5) + r.choice([".", "", ":"])
        out = self.mine(text)
        if r.random() < 0.35:
            inner = r.choice(["a href='/x'", "b", "em", "span class='name'", "a href='/y' class='link'", "code", "span class='author'", "time class='date'", "span class='note'"])
            out += f" <{inner}>{self.mine(self.words(1, 5))}</{inner.split()[0]}> {self.mine(self.sentences(1))}"
        return out

    def article_blocks(self) -> list[str]:
        r = self.rnd
        out = []
        loose = r.random()
        for _ in range(r.choices([1, 2, 3, 6, 12], [3, 2, 3, 4, 2])[0]):
            kind = r.choices(["p", "open", "list", "quote", "table", "pre", "figure", "heading"], [16, 3, 1, 1, 0.7, 0.5, 0.5, 2])[0]
            if kind == "p" and loose < 0.12:
                out.append(self.paragraph() + "<br><br>")
            elif kind == "p" and loose < 0.25:
                out.append(f"<div>{self.paragraph()}</div>")
            elif kind == "p":
                out.append(f"<p>{self.paragraph()}" + ("</p>" if r.random() < 0.85 else ""))
            elif kind == "open":
                out.append(f"<p><b>{self.paragraph()}<br>")
            elif kind == "list":
                items = [self.mine(self.sentences(1, 2, 20)) for _ in range(r.randint(2, 6))]
                items = [f"<a href='/{k}'>{i}</a> {self.mine(self.words(2, 9))}" if r.random() < 0.2 else i for k, i in enumerate(items)]
                out.append("<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>")
            elif kind == "quote":
                out.append(f"<blockquote>{self.paragraph()}</blockquote>")
            elif kind == "table":
                rows = ["<tr>" + "".join(f"<td>{self.mine(self.words(1, 4))}</td>" for _ in range(r.randint(2, 4))) + "</tr>" for _ in range(3)]
                out.append("<table>" + "".join(rows) + "</table>")
            elif kind == "pre":
                out.append(f"<pre><code>{self.mine(self.words(3, 20))}\n  {self.mine(self.words(3, 20))}</code></pre>")
            elif kind == "figure":
                out.append(f"<figure><img src=x><figcaption>{self.mine(self.sentences(1))}</figcaption></figure>")
            else:
                out.append(f"<h{r.randint(2, 4)}>{self.mine(self.words(1, 9))}</h2>")
        return out

    def article(self) -> str:
        r = self.rnd
        blocks = self.article_blocks()
        for noise, chance in ((self.advert, 0.25), (self.share, 0.15), (self.search, 0.2), (self.sidebar, 0.15), (self.notice, 0.12)):
            if r.random() < chance:
                blocks.insert(r.randint(0, len(blocks)), noise())
        title = f"<h1>{self.mine(self.words(2, 14) + r.choice(['', '.']))}</h1>"
        if r.random() < 0.15:
            byline = f"<p class='byline'>{self.words(2, 4)}</p>" if r.random() < 0.5 else ""
            title = f"<header>{title}{byline}</header>"
        if r.random() < 0.85:
            blocks.insert(0, title)
        if r.random() < 0.1:
            blocks.append(f"<footer>{html.escape(self.words(2, 8))} {self.links(1, 3)}</footer>")
        inner = "".join(blocks)
        if r.random() < 0.3:
            inner = self.part("main", inner, tag="div")
        out = self.part("main", inner, tag=r.choice(["article", "article", "main", "section"]) if self.style == "tags" else None)
        return f"<main>{out}</main>" if self.style == "tags" and r.random() < 0.3 else out

    # --- the page
    def text(self) -> str:
        r = self.rnd
        some = lambda make, chance, most=1: [make() for _ in range(r.randint(1, most)) if r.random() < chance]
        before = some(self.page_header, 0.6) + some(self.menu, 0.75) + some(self.notice, 0.3) + some(self.advert, 0.4)
        after = some(self.comments, 0.35) + some(self.share, 0.15) + some(self.advert, 0.2) + some(self.search, 0.2)
        side = some(self.sidebar, 0.5, 2) + some(self.search, 0.15)
        article = self.article() if r.random() < 0.97 else ""
        if r.random() < 0.2:
            article, after = self.part("main", article + "".join(after), tag="div"), []
        if self.style == "table":
            cells = [article + "".join(after), "".join(side) or self.links(3, 9)]
            r.shuffle(cells)
            middle = "<table><tr>" + "".join(f"<td valign=top>{c}</td>" for c in cells) + "</tr></table>"
        else:
            columns = [article, *after, *side] if r.random() < 0.5 else [*side, article, *after]
            middle = "".join(columns)
            if r.random() < 0.3:
                middle = f'<div class="{r.choice([*PLAIN_WRAPS, "content-sidebar-wrap", "page", "main-wrapper has-sidebar"])}">{middle}</div>'
        end = some(self.page_footer, 0.8) + some(self.notice, 0.12)
        body = "".join(before) + middle + "".join(end)
        if r.random() < 0.015:
            body = f"<form id=aspnetForm action=/>{body}</form>"
        head = f'<head><meta charset="utf-8"><title>{self.words(2, 9)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
        return f"<!DOCTYPE html><html>{head}<body>{body}" + ("</body></html>" if r.random() < 0.7 else "")


def labelled_pages(n: int, seed: int) -> Iterator[str]:
    """The first n pages of a seed."""
    for k in range(n):
        yield _Page(random.Random(f"{seed}:{k}")).text()
