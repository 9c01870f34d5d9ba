"""Generated pages with known main text, to fit the extractor on.

A page is laid out at random from the usual parts: site header, menus, notices,
adverts, the article, sidebars, forms, reader comments, footer.  Names of classes
and elements, nesting, order and lengths vary.  Main text blocks begin with MARK.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

MARK = "\x01"
_SYLLABLES = "an ba con de er fa gi ho in ka lo men ne on pra qui re st ta un ver wi xo ya zu ch sh ü é ñ ß la mo ti or".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.style = self.r.random()  # how far the page uses speaking names
        self.plain = self.r.random() < 0.35  # speaking elements need no names

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = [self.word() for _ in range(r.randint(low, high))]
        kind = r.random()
        if kind < 0.06:
            out = [w + r.choice(("%%%", "***", "###", "$$$", "&amp;&amp;&amp;")) for w in out]
        elif kind < 0.1:
            out = [w.upper() + r.choice(("", "!!")) for w in out]
        elif kind < 0.14:
            out = [r.choice((w, str(r.randint(0, 10**6)), "|", "http://" + w + ".example/" + w, w + "@" + w + ".example")) for w in out]
        out[0] = out[0].capitalize()
        if kind >= 0.14:
            for i in range(len(out) - 1):
                if r.random() < 0.1:
                    out[i] += r.choice((",", ".", ","))
        return " ".join(out) + r.choice((".", ".", ".", "", "!"))

    def inline(self, text: str) -> str:
        r = self.r
        if r.random() < 0.25:
            parts = text.split(" ")
            i = r.randrange(len(parts))
            tag = r.choice(("b", "i", "em", "strong", "a href='/x'", "code", "span"))
            parts[i] = f"<{tag}>{parts[i]}</{tag.split()[0]}>"
            text = " ".join(parts)
        if r.random() < 0.08:
            text = text.replace(" ", "<br>", 1)
        return text

    def attr(self, *names: str, always: bool = False) -> str:
        r = self.r
        if not always and self.plain:
            return ""
        if not always and r.random() > 0.35 + 0.65 * self.style:
            return r.choice(("", "", f' class="{self.word()}"', ' class="row"', ' class="col-8 wrap"'))
        name = r.choice(names)
        name = r.choice((name, name, name, f"site-{name}", f"{name}-{self.word()}", f"{name}_1", f"page-{name}", f"js-{name} block"))
        return r.choice((f' class="{name}"', f' id="{name}"', f' class="{name} {self.word()}"', f" class='{name}' data-x=\"1\""))

    def links(self, low: int, high: int) -> str:
        r = self.r
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(r.randint(low, high))]
        shape = r.random()
        if shape < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return r.choice((" | ", " ", "<br>")).join(items) if shape < 0.8 else "".join(f"<div>{x}</div>" for x in items)

    def blurb(self, most: int = 25) -> str:
        text = self.words(2, most)
        return self.r.choice((text, f"<p>{text}</p>", f"<p>{self.inline(text)}</p><p>{self.words(2, most)}</p>", f"<h3>{self.words(1, 4)}</h3><p>{text}</p>", f"<span>{text}</span>"))

    # Parts that are never main text.
    def header(self) -> str:
        tag = self.r.choice(("header", "header", "div"))
        logo = self.r.choice((f"<h1>{self.words(1, 3)}</h1>", f"<a href='/'>{self.words(1, 3)}</a>", f"<div class='logo'>{self.words(1, 2)}</div><p>{self.words(3, 8)}</p>"))
        return f"<{tag}{self.attr('header', 'masthead', 'top', 'banner', 'branding', always=tag == 'div')}>{logo}{self.r.choice(('', self.menu(), self.form()))}</{tag}>"

    def menu(self) -> str:
        tag = self.r.choice(("nav", "nav", "nav", "div", "ul"))
        inner = self.links(3, 9)
        if tag == "ul":
            inner = "".join(f"<li><a href='/'>{self.words(1, 2)}</a></li>" for _ in range(self.r.randint(3, 8)))
        return f"<{tag}{self.attr('nav', 'menu', 'navigation', 'breadcrumb', 'navbar', 'pagination', always=tag == 'div')}>{inner}</{tag}>"

    def notice(self) -> str:
        tag = self.r.choice(("div", "div", "aside", "section", "p"))
        text = self.words(4, 40) if tag == "p" else self.blurb(40)
        return f"<{tag}{self.attr('cookie-notice', 'consent', 'alert', 'notice', 'popup', 'gdpr', 'newsletter', 'paywall', 'notification', 'subscribe', always=True)}>{text}{self.r.choice(('', '<button>OK</button>'))}</{tag}>"

    def advert(self) -> str:
        tag = self.r.choice(("div", "div", "div", "aside", "ins", "section", "p"))
        text = self.words(2, 45) if tag in ("p", "ins") or self.r.random() < 0.6 else self.blurb(45)
        return f"{self.r.choice(('', '<!-- ad -->'))}<{tag}{self.attr('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'ad-slot', 'adbox', 'banner-ad', always=True)}>{text}</{tag}>"

    def sidebar(self) -> str:
        tag = self.r.choice(("aside", "aside", "div", "section"))
        parts = [f"<div{self.attr('widget', 'box', 'related', 'popular')}>{self.r.choice((self.blurb(30), self.links(2, 8), '<h3>' + self.words(1, 3) + '</h3>' + self.links(2, 6)))}</div>" for _ in range(self.r.randint(1, 4))]
        if self.r.random() < 0.2:
            parts = [self.blurb(60)]
        return f"<{tag}{self.attr('sidebar', 'side', 'related', 'rail', 'secondary', 'widget-area', always=tag != 'aside')}>{''.join(parts)}</{tag}>"

    def form(self) -> str:
        inner = f"<label>{self.words(1, 3)}</label><input name='q'><button>{self.words(1, 1)}</button>"
        if self.r.random() < 0.4:
            inner = f"<p>{self.words(3, 20)}</p>" + inner + f"<select><option>{self.word()}</option></select><textarea>{self.word()}</textarea>"
        return f"<form{self.attr('search', 'login', 'signup', 'contact', 'newsletter')} action='/'>{inner}</form>"

    def comments(self) -> str:
        r = self.r
        tag, item = r.choice((("div", "div"), ("section", "div"), ("ol", "li"), ("ul", "li"), ("section", "article"), ("div", "p")))
        body = lambda: self.words(2, 60) if item == "p" else r.choice((f"<p>{self.words(2, 60)}</p>", f"<b>{self.word()}</b><p>{self.words(2, 50)}</p><p>{self.words(2, 30)}</p>", self.words(2, 40)))
        items = "".join(f"<{item}{self.attr('comment', 'reply', 'comment-body', always=item == 'article')}>{body()}</{item}>" for _ in range(r.randint(1, 7)))
        title = f"<h2>{self.words(1, 3)}</h2>" if r.random() < 0.5 and tag not in ("ol", "ul") else ""
        return f"<{tag}{self.attr('comments', 'comment-list', 'discussion', 'respond', 'reader-comments', 'disqus_thread', always=True)}>{title}{items}{r.choice(('', self.form())) if tag not in ('ol', 'ul') else ''}</{tag}>"

    def share(self) -> str:
        return f"<div{self.attr('share', 'social', 'tools', 'related', 'follow', always=True)}>{self.r.choice((self.links(2, 5), self.words(1, 4)))}</div>"

    def footer(self) -> str:
        tag = self.r.choice(("footer", "footer", "div"))
        r_most = self.r.choice((15, 60))
        inner = self.r.choice((f"&copy; {self.word()}.example &middot; {self.words(2, r_most)}", f"<p>&copy; 2024 {self.words(2, 12)}</p>", self.links(3, 10), f"{self.links(2, 6)}<p>{self.words(4, 30)}</p>"))
        return f"<{tag}{self.attr('footer', 'colophon', 'bottom', 'copyright', always=tag == 'div')}>{inner}</{tag}>"

    # The article.
    def main_block(self) -> str:
        r = self.r
        short = r.random() < 0.3
        long = r.choice((20, 90, 90, 250))
        text = lambda low=1, high=long: MARK + self.inline(self.words(low, 5 if short else high))
        kind = r.random()
        if kind < 0.66:
            return r.choice((f"<p>{text()}</p>", f"<p>{text()}</p>", f"<p>{text()}", f"<p><b>{text()}<br>", f"<p class='{self.word()}'>{text()}</p>"))
        if kind < 0.74:
            return f"<h{(k := r.choice('223'))}>{MARK}{self.words(1, 8)}</h{k}>"
        if kind < 0.82:
            return "<ul>" + "".join(f"<li>{text(1, 20)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if kind < 0.87:
            return f"<blockquote><p>{text()}</p></blockquote>"
        if kind < 0.9:
            return f"<pre>{text()}</pre>"
        if kind < 0.93:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{MARK}{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if kind < 0.95:
            return f"<figure><img src='/x.png'><figcaption>{text(2, 12)}</figcaption></figure>"
        return f"<div>{text()}</div>"

    def article(self) -> str:
        r = self.r
        blocks = [self.main_block() for _ in range(r.choice((1, 1, 2, 3, 5, 8, 12, 20, 40)))]
        if r.random() < 0.4:  # paragraphs only
            blocks = [b for b in blocks if b.startswith('<p')] or [f"<p>{MARK}{self.words(1, 30)}</p>"]
        if r.random() < 0.12:
            blocks = [f"<div>{MARK}{self.inline(self.words(5, 80))}</div>" for _ in blocks]
        for part, chance in ((self.advert, 0.25), (self.share, 0.2), (self.form, 0.06), (self.notice, 0.08), (self.menu, 0.05), (self.sidebar, 0.06)):
            if r.random() < chance:
                blocks.insert(r.randint(0, len(blocks)), part())
        title = f"<h1>{MARK}{self.words(1, 14)}</h1>" if r.random() < 0.75 else ""
        if title and r.random() < 0.15:
            title = f"<header>{title}</header>"
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section", "td"))
        inner = "".join(blocks)
        if r.random() < 0.3:
            inner = f"<div{self.attr('content', 'entry-content', 'post-body', 'article-text', 'story')}>{inner}</div>"
        if r.random() < 0.12:
            inner += self.comments()
        body = f"<{tag}{self.attr('article', 'content', 'main', 'post', 'entry', 'story', 'main-content')}>{title}{inner}</{tag}>"
        if tag == "td":
            body = f"<table><tr><td>{self.links(2, 8)}</td>{body}</tr></table>"
        for _ in range(r.choice((0, 0, 1, 2))):
            body = f"<{(w := r.choice(('div', 'main', 'section', 'div')))}{r.choice(('', ' class=wrap', ' id=page', self.attr('main', 'container', 'content')))}>{body}{r.choice(('', '', self.sidebar(), self.comments()))}</{w}>"
        return body

    def page(self) -> str:
        r = self.r
        before = [f() for f, chance in ((self.notice, 0.3), (self.header, 0.55), (self.menu, 0.7), (self.advert, 0.4), (self.form, 0.15), (self.sidebar, 0.15)) if r.random() < chance]
        after = [f() for f, chance in ((self.advert, 0.2), (self.share, 0.15), (self.sidebar, 0.35), (self.comments, 0.35), (self.form, 0.1), (self.notice, 0.15), (self.menu, 0.2), (self.footer, 0.8)) if r.random() < chance]
        body = "".join(before) + (self.article() if r.random() > 0.02 else "") + "".join(after)
        if r.random() < 0.2:
            body = f"<div id='{r.choice(('page', 'wrapper', 'root', 'app'))}'>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title><style>p{{margin:0}}</style></head><body>{body}<script>var t='</p>';</script></body></html>"


def pages(n: int, seed: int = 11) -> Iterator[str]:
    """``n`` pages, the same for the same seed."""
    for i in range(n):
        yield _Maker(seed * 1_000_003 + i).page()
