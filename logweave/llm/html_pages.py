"""Labelled pages for the extraction model: built by rule, with a mark on what is content.

Every page is put together from parts that web pages have, in many layouts: with and without
telling element names and class names, nested and flat, with inline markup and with boxes inside
the article.  ``data-content`` marks a part (and what lies in it) as content (1) or not (0); the
parser hands the mark to the trainer, and no feature reads it.
"""

from __future__ import annotations

import random
import re

WORDS = (
    "time year people way day man thing woman life child world school state family student group country problem hand "
    "part place case week company system program question work government number night point home water room mother "
    "area money story fact month lot right study book eye job word business issue side kind head house service friend "
    "father power hour game line end member law car city community name president team minute idea kid body information"
).split()
MENU = "Home News Sport About Contact Login Register Shop Help Archive Topics Weather Video Jobs Search More".split()

#: Class or id names that sites give to parts, by part.
NAMES = {
    "nav": ["nav", "menu", "navbar", "main-nav", "topnav", "navigation", "breadcrumb", "pagination"],
    "header": ["header", "site-header", "masthead", "top", "banner", "page-header"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "page-footer", "legal"],
    "sidebar": ["sidebar", "side", "aside", "widget", "rail", "related", "right-column"],
    "notice": ["notice", "cookie", "cookie-notice", "alert", "consent", "gdpr", "popup", "modal", "message"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "adsbygoogle", "banner-ad", "sponsor"],
    "comments": ["comments", "comment", "comment-list", "responses", "discussion", "replies", "disqus"],
    "form": ["form", "subscribe", "newsletter", "signup", "search", "login"],
    "share": ["share", "social", "sharing", "tags", "meta", "byline", "author-box"],
    "content": ["content", "article", "post", "entry", "main", "story", "post-content", "entry-content", "article-body",
                "text", "body", "page"],
}
#: Elements that stand for a part.
ELEMENTS = {"nav": "nav", "header": "header", "footer": "footer", "sidebar": "aside"}


class Builder:
    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def sentence(self) -> str:
        count = self.random.randint(4, 18)
        words = [self.random.choice(WORDS) for _ in range(count)]
        if self.random.random() < 0.3:
            words[count // 2] += ","
        return words[0].capitalize() + " " + " ".join(words[1:]) + self.random.choice("....?!")

    def odd_text(self) -> str:
        """Text that is no prose: repeated words, word lists, signs, no stops."""
        count = self.random.randint(10, 900)
        kind = self.random.randrange(4)
        if kind == 0:
            return " ".join([self.random.choice(WORDS) + self.random.choice(["", ".", ","])] * count)
        if kind == 1:
            return self.random.choice([" | ", " ", "!! ", "### "]).join(self.random.choices(WORDS, k=count))
        if kind == 2:
            return " ".join(w.upper() + "!!" for w in self.random.choices(WORDS, k=count))
        return " ".join(w + self.random.choice(["&amp;&amp;&amp;", "$$$", "***", ""]) for w in self.random.choices(WORDS, k=count))

    def prose(self, most: int = 6) -> str:
        if most == 6 and self.random.random() < 0.25:
            return self.odd_text()
        if most == 6 and self.random.random() < 0.15:
            most = 60
        parts = [self.sentence() for _ in range(self.random.randint(1, most))]
        if self.random.random() < 0.3:
            at = self.random.randrange(len(parts))
            tag = self.random.choice(["b", "i", "em", "strong", "a href='/x'", "span", "code"])
            parts[at] = f"<{tag}>{parts[at]}</{tag.split()[0]}>"
        if self.random.random() < 0.15:
            parts.insert(self.random.randrange(len(parts) + 1), "<br>")
        return " ".join(parts)

    def attribute(self, part: str, often: float) -> str:
        if self.random.random() > often:
            return ""
        return f' {self.random.choice(["class", "class", "id"])}="{self.random.choice(NAMES[part])}"'

    def links(self) -> str:
        texts = [self.random.choice(MENU + WORDS) for _ in range(self.random.randint(1, 9))]
        plain = self.random.random() < 0.15
        items = texts if plain else [f'<a href="/{n}">{text}</a>' for n, text in enumerate(texts)]
        if self.random.random() < 0.6:
            return "<ul>" + "".join(f"<li>{a}</li>" for a in items) + "</ul>"
        return self.random.choice([" | ", " ", ""]).join(items)

    def junk_text(self) -> str:
        kind = self.random.random()
        if kind < 0.4:
            return self.sentence()
        if kind < 0.6:
            return f"<p>{self.prose(3)}</p>"
        if kind < 0.7:
            return f"&copy; {self.random.choice(WORDS)} &middot; {self.sentence()}"
        return " ".join(self.random.choice(WORDS) for _ in range(self.random.randint(1, 5)))

    def part(self, name: str) -> str:
        element = ELEMENTS.get(name) if self.random.random() < 0.6 else None
        often = 0.5 if element else 1.0
        element = element or self.random.choice(["div", "div", "section", "ul" if name == "share" else "div"])
        if name == "form" and self.random.random() < 0.8:
            element, often = "form", 0.5
        inner = self.links() if name == "nav" else self.junk_text()
        if name in ("header", "footer", "sidebar") and self.random.random() < 0.5:
            inner += self.links()
        if name == "header" and self.random.random() < 0.4:
            inner = f"<h1>{self.sentence()}</h1>" + inner
        if name == "form":
            inner = f"<label>{self.sentence()}</label><input name=q><button>Send</button>" + (f"<p>{self.sentence()}</p>" if self.random.random() < 0.5 else "")
        if name == "comments":
            inner = "<h3>Comments</h3>" + "".join(
                f"<{t}{self.attribute('comments', 0.5)}><p>{self.prose(3)}</p></{t}>"
                for t in [self.random.choice(["li", "div", "section"])] for _ in range(self.random.randint(1, 3))
            )
        if element == "ul":
            inner = f"<li>{inner}</li>"
        return f'<{element}{self.attribute(name, often)} data-content="0">{inner}</{element}>'

    def article(self) -> str:
        blocks = []
        if self.random.random() < 0.8:
            blocks.append(f"<h1>{self.sentence() if self.random.random() < 0.5 else ' '.join(self.random.choices(WORDS, k=4))}</h1>")
        for _ in range(self.random.randint(1, self.random.choice([3, 9, 9, 40]))):
            kind = self.random.random()
            if kind < 0.7:
                blocks.append(f"<p>{self.prose()}" + ("</p>" if self.random.random() < 0.9 else ""))
            elif kind < 0.78:
                blocks.append(f"<h2>{' '.join(self.random.choices(WORDS, k=3))}</h2>")
            elif kind < 0.84:
                blocks.append("<ul>" + "".join(f"<li>{self.prose(2)}</li>" for _ in range(self.random.randint(1, 4))) + "</ul>")
            elif kind < 0.88:
                blocks.append(f"<blockquote><p>{self.prose(2)}</p></blockquote>")
            elif kind < 0.91:
                rows = "".join(f"<tr><td>{self.random.choice(WORDS)}</td><td>{self.random.randint(1, 99)}</td></tr>" for _ in range(3))
                blocks.append(f"<table>{rows}</table>")
            elif kind < 0.94:
                blocks.append(f"<pre>{self.sentence()}</pre>")
            elif kind < 0.97:
                blocks.append(f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>")
            else:
                blocks.append(f"<p>{self.random.choice(WORDS).capitalize()}.</p>")
        tiny = self.random.random() < 0.12
        if tiny:
            word = lambda: self.random.choice(WORDS).capitalize() + self.random.choice([".", "", "!"])
            blocks = [f"<h1>{word()}</h1>"] + [f"<p>{word()}</p>" for _ in range(self.random.randint(1, 4))]
        elif self.random.random() < 0.2:
            # Many short lines: a poem, a word list, a transcript.
            short = lambda: " ".join(self.random.choices(WORDS, k=self.random.randint(1, 4))) + self.random.choice([".", "", ","])
            at = self.random.randint(0, len(blocks))
            blocks[at:at] = [f"<p>{short()}</p>" for _ in range(self.random.randint(5, 80))]
        for name in ("ad", "share", "form", "sidebar", "notice", "comments"):
            if self.random.random() < 0.12:
                blocks.insert(self.random.randint(1, len(blocks)), self.part(name))
        if self.random.random() < 0.12 and not tiny:
            # No element around the article: its blocks lie in the page's body.
            marked = [b if 'data-content="0"' in b else re.sub(r"^<(\w+)", r'<\1 data-content="1"', b) for b in blocks]
            return "".join(marked)
        inner = "".join(blocks)
        if self.random.random() < 0.5:
            inner = f"<div{self.attribute('content', 0.6)}>{inner}</div>"
        element = self.random.choice(["article", "article", "div", "main", "section", "td"][: 2 if tiny else None])
        often = 1.0 if element in ("div", "section") and self.random.random() < 0.8 else 0.4
        made = f'<{element}{self.attribute("content", often)} data-content="1">{inner}</{element}>'
        if element == "td":
            made = f"<table><tr>{made}</tr></table>"
        return f'<main data-content="1">{made}</main>' if self.random.random() < 0.15 else made

    def page(self) -> str:
        before = [self.part(n) for n in ("header", "nav", "notice", "ad", "sidebar", "form") if self.random.random() < 0.5]
        after = [self.part(n) for n in ("comments", "share", "sidebar", "ad", "form", "nav") if self.random.random() < 0.4]
        if self.random.random() < 0.8:
            after.append(self.part("footer"))
        if self.random.random() < 0.12:
            before, after = [], []
        self.random.shuffle(before)
        inner = "".join(before) + self.article() + "".join(after)
        if self.random.random() < 0.3:
            inner = f'<div{self.random.choice(["", " class=wrapper", " id=container", " class=page"])}>{inner}</div>'
        title = f"<title>{self.sentence()}</title><style>p{{}}</style><script>var a='<p>';</script>"
        end = "</body></html>" if self.random.random() < 0.9 else ""
        return f'<!DOCTYPE html><html><head>{title}</head><body data-content="0">{inner}{end}'


def labelled_pages(count: int = 600, seed: int = 3) -> list[str]:
    builder = Builder(seed)
    return [builder.page() for _ in range(count)]
