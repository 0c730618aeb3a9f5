"""Labelled web pages of many layouts, made by rule, to train the content model on.

Layouts differ in how they mark things: by HTML5 elements, by class words on
plain divisions, or both; parts come and go, tags stay unclosed, and articles
run from one word to dozens of paragraphs.
"""

from __future__ import annotations

import html
import random

_SYLLABLES = "ka lo mi ter an en or in der que ti on ra ve su pla mo net ix ul é ñ ö ção sch".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _words(r: random.Random, n: int) -> str:
    return " ".join(_word(r) for _ in range(n))


def _sentences(r: random.Random, n: int) -> str:
    return " ".join(f"{_words(r, r.randint(1, 14)).capitalize()}{r.choice(['.', '.', '.', '?', '!', ','])}" for _ in range(n))


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.content: set[str] = set()
        #: how parts are marked
        self.semantic = self.r.random()

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def mark(self, tag: str, names: list[str], inner: str, also: float = 0.4) -> str:
        """``inner`` in an element that says what it is: by tag, by class or id, or both."""
        r = self.r
        by_tag = tag != "div" and r.random() < self.semantic
        name = r.choice(names)
        by_name = not by_tag or r.random() < also
        attr = f' {r.choice(["class", "class", "id"])}="{name}"' if by_name else ""
        return f"<{tag if by_tag else 'div'}{attr}>{inner}</{tag if by_tag else 'div'}>"

    def links(self, n: int) -> str:
        r = self.r
        items = [f'<a href="/{_word(r)}">{_words(r, r.randint(1, 3))}</a>' for _ in range(n)]
        style = r.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return (" | " if style < 0.8 else " ").join(items)

    def prose(self, kind: str = "p") -> str:
        """A block of article text."""
        r = self.r
        text = _sentences(r, r.choice([1, 1, 2, 3, 5, 9, 20]))
        if self.chance(0.6 if kind[0] == "h" else 0.12):
            text = _words(r, r.randint(1, 9)).capitalize()
        if self.chance(0.1):
            text = " ".join(w + r.choice(["", "&", " #", "%", "$", "***"]) for w in text.split())
        if self.chance(0.08):
            text = " | ".join(text.split())
        if self.chance(0.06):
            text = text.upper()
        if self.chance(0.06):
            times = r.choice([1, 12, 20])
            text = " ".join(w for w in _words(r, r.randint(2, 20)).split() for _ in range(times)) + r.choice(["", "."])
        if self.chance(0.05):
            text = f"{r.choice(['©', '|', 'Copyright ©'])} {text}"
        self.content.add(" ".join(text.split()))
        text = html.escape(text, quote=self.chance(0.5))
        if self.chance(0.15):
            at = text.find(" ")
            if at > 0 and "&" not in text[:at]:
                text = f'{r.choice(["<b>", "<em>", "<a href=x>"])}{text[:at]}</{"b" if self.chance(0.3) else "a"}>{text[at:]}'
        if kind == "p":
            form = r.random()
            if form < 0.75:
                return f"<p>{text}</p>"
            if form < 0.85:
                return f"<p>{text}"
            return f"<p><b>{text}<br>"
        return f"<{kind}>{text}</{kind}>"

    def article(self) -> str:
        r = self.r
        parts = [self.prose(r.choice(["h1", "h1", "h2"]))] if self.chance(0.85) else []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 15, 25])):
            x = r.random()
            if x < 0.82:
                parts.append(self.prose())
            elif x < 0.88:
                parts.append(self.prose(r.choice(["h2", "h3"])))
            elif x < 0.92:
                parts.append("<ul>" + "".join(self.prose("li") for _ in range(r.randint(1, 4))) + "</ul>")
            elif x < 0.95:
                parts.append("<blockquote>" + self.prose() + "</blockquote>")
            elif x < 0.97:
                parts.append("<table><tr>" + self.prose("td") + self.prose("td") + "</tr></table>")
            else:
                parts.append(self.prose("pre"))
            if self.chance(0.05):
                parts.append(self.noise())
        if self.chance(0.1):  # verse, or a line again and again
            lines = [_words(r, r.randint(1, 4)).capitalize() + r.choice(["", "", "."]) for _ in range(r.choice([1, 2, 12]))]
            for _ in range(r.choice([3, 10, 30])):
                line = r.choice(lines)
                self.content.add(line)
                parts.append(f"<p>{line}</p>")
        inner = "".join(parts)
        if self.chance(0.4):
            inner = f'<div class="{r.choice(["content", "entry-content", "post-body", "article-text", "story", "c1"])}">{inner}</div>'
        if self.chance(0.2):
            inner += self.mark("div", ["share", "social-share", "tags", "related"], self.links(3))
        if self.chance(0.15):
            inner += self.comments()
        inner = self.mark("article", ["article", "post", "entry", "main-content", "story-body"], inner, 0.3)
        return self.mark("main", ["main", "content", "page-content"], inner) if self.chance(0.35) else inner

    def noise(self) -> str:
        r = self.r
        return r.choice(
            [
                lambda: self.mark("div", ["ad", "ads", "advert", "ad-slot", "sponsored", "promo"], _sentences(r, r.randint(1, 4))),
                lambda: self.mark("aside", ["sidebar", "widget", "related"], f"<h3>{_words(r, 2)}</h3>" + (self.links(4) if self.chance(0.6) else f"<p>{_sentences(r, 3)}</p>")),
                lambda: self.mark("div", ["cookie", "cookie-notice", "consent", "banner", "alert", "notice", "gdpr"], f"<p>{_sentences(r, 2)}</p>" + f"<button>{_word(r)}</button>" * self.chance(0.6)),
                lambda: self.mark("form", ["newsletter", "subscribe", "search", "login", "signup"], f"<label>{_words(r, 2)}</label><input name=q><button>{_word(r)}</button>" + f"<p>{_sentences(r, 1)}</p>" * self.chance(0.4)),
            ]
        )()

    def comments(self) -> str:
        r = self.r
        one = lambda: r.choice(
            [
                lambda: f'<div class="comment"><p>{_sentences(r, r.randint(1, 5))}</p></div>',
                lambda: f'<li class="comment"><b>{_word(r)}</b><p>{_sentences(r, 2)}</p></li>',
                lambda: f'<article class="comment"><header>{_word(r)}</header><p>{_sentences(r, 3)}</p></article>',
                lambda: f"<p>{_sentences(r, r.randint(1, 6))}</p>",
            ]
        )()
        inner = f"<h2>{_words(r, 1)}</h2>" * self.chance(0.6) + "".join(one() for _ in range(r.randint(1, 5)))
        name = r.choice(["comments", "comment-list", "discussion", "replies", "respond", "user-comments"])
        tag = r.choice(["div", "section", "aside", "ol"])
        return f'<{tag} {r.choice(["class", "id"])}="{name}">{inner}</{tag}>'

    def page(self) -> tuple[str, set[str]]:
        r = self.r
        parts = [f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{_words(r, 4)}</title><style>p{{margin:0}}</style>']
        parts.append(f'<script>var t="</p>";track({r.randint(0, 9)});</script></head><body>')
        if self.chance(0.08):  # nothing but the article
            return "".join([*parts, self.article(), "</body></html>"]), self.content
        if self.chance(0.15):
            parts.append(f'<a class="skip" href="#main">{_words(r, 3)}</a>')
        if self.chance(0.5):
            parts.append(self.mark("header", ["header", "masthead", "topbar"], f"<h1>{_words(r, 2)}</h1>" * self.chance(0.4) + f"<p>{_sentences(r, 1)}</p>" * self.chance(0.4) + (self.mark("nav", ["nav", "menu"], self.links(5)) if self.chance(0.4) else _words(r, 2))))
        if self.chance(0.8):
            parts.append(self.mark("nav", ["nav", "navbar", "menu", "navigation"], self.links(r.randint(2, 8))))
        if self.chance(0.2):
            parts.append(self.mark("div", ["breadcrumb", "breadcrumbs"], self.links(3)))
        for _ in range(r.choice([0, 1, 1, 2])):
            parts.append(("<!-- ad -->" if self.chance(0.5) else "") + self.noise())
        middle = [self.article()]
        if self.chance(0.3):
            middle.insert(r.choice([0, 1]), self.noise())
        inner = "".join(middle)
        parts.append(f'<div class="{r.choice(["wrapper", "container", "row", "page"])}">{inner}</div>' if self.chance(0.3) else inner)
        if self.chance(0.3):
            parts.append(self.comments())
        for _ in range(r.choice([0, 0, 1])):
            parts.append(self.noise())
        if self.chance(0.85):
            parts.append(self.mark("footer", ["footer", "foot", "copyright", "bottom"], f"&copy; {_word(r)} &middot; {_sentences(r, 1)}" if self.chance(0.6) else f"<p>{_sentences(r, 2)}</p>" + self.links(3)))
        if self.chance(0.8):
            parts.append("</body></html>")
        return "".join(parts), self.content


def labelled_pages(n: int, seed: int = 1) -> list[tuple[str, set[str]]]:
    """``n`` pages with the texts of their content runs; the same for the same seed."""
    return [_Page(seed * 1_000_003 + i).page() for i in range(n)]
