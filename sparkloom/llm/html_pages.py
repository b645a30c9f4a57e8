"""Labelled pages to learn from: layouts of many kinds, made by rule from a seed.

Every block's element carries ``data-label`` (1: main text, 0: anything else), which its descendants
inherit.  Names of classes are drawn from what such regions are commonly called, and are often missing, so
that a model has to use structure, links and sizes too.  Words are invented: nothing is learned of a language.
"""

from __future__ import annotations

import random

#: What regions are commonly called in classes and ids.
NAMES = {
    "content": "article content post entry story main body text single hentry prose articleBody post-content entry-content main-content article-body page-content blog-post".split(),
    "nav": "nav navbar menu main-menu navigation topnav site-nav mainNav nav-links menu-primary breadcrumb breadcrumbs toc pagination pager".split(),
    "header": "header site-header masthead top-bar topbar page-header banner branding logo".split(),
    "footer": "footer site-footer bottom foot copyright colophon legal page-footer footer-links".split(),
    "sidebar": "sidebar side aside right-rail widget widgets secondary related related-posts recommended trending most-read sidebar-right".split(),
    "ad": "ad ads advert advertisement adsbygoogle ad-slot sponsored sponsor promo promoted banner-ad adBox commercial".split(),
    "notice": "cookie cookies cookie-notice cookie-banner consent gdpr notice alert popup modal overlay site-notice privacy-banner message".split(),
    "form": "newsletter subscribe signup search search-form login contact-form form".split(),
    "share": "share sharing social social-links share-buttons follow tags toolbar print-links".split(),
    "comments": "comments comment comment-list commentlist comments-area disqus replies reply respond discussion reader-comments user-comments".split(),
}
AROUND = "wrap wrapper container row col inner outer grid layout site page section block box clearfix u-flex".split()
TAGS = {"content": ["article", "main", "div", "section"], "nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"], "ad": ["div", "aside", "section"], "notice": ["div", "section", "aside", "dialog"], "form": ["form", "div", "section"], "share": ["div", "ul", "section"], "comments": ["section", "div", "ol", "ul"]}
#: How often a region has its own tag, and then goes without a class.
OWN_TAG, BARE = 0.5, 0.5
_SYLLABLES = "ka le mi to ra sen dor vil an per qua ish ent ou ber ge tion ia lo sch é ñu ö th ing st".split()
_spelt = random.Random(0)
#: Invented words, from which all texts are drawn.
WORDS = ["".join(_spelt.choice(_SYLLABLES) for _ in range(_spelt.randint(1, 4))) for _ in range(4096)]


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.style = self.r.choice(["plain", "plain", "plain", "symbols", "bare"])

    def word(self) -> str:
        return WORDS[int(self.r.random() * len(WORDS))]

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high))).capitalize()

    def sentence(self, low: int = 1, high: int = 18) -> str:
        text = self.phrase(low, high)
        if self.style == "symbols":
            return " ".join(w + self.r.choice(["###", "***", "%%%", "$$$", "&amp;&amp;", ""]) for w in text.split())
        return text + ("" if self.style == "bare" and self.r.random() < 0.5 else self.r.choice(".....!?"))

    def prose(self, most: int) -> str:
        out = []
        for _ in range(self.r.randint(1, most)):
            s = self.sentence()
            kind = self.r.random()
            out.append(f"<a href='/x'>{s}</a>" if kind < 0.04 else f"<em>{s}</em>" if kind < 0.1 else s)
        return " ".join(out)

    def open(self, region: str, tag: str = "", label: int | None = None) -> tuple[str, str]:
        own = self.r.random() < OWN_TAG
        tag = tag or (TAGS[region][0] if own else self.r.choice(TAGS[region]))
        named = not (tag not in ("div", "ul", "ol", "section") and self.r.random() < BARE) and self.r.random() > 0.06
        words = [self.r.choice(NAMES[region])] + ([self.r.choice(AROUND)] if self.r.random() < 0.3 else [])
        self.r.shuffle(words)
        value = self.r.choice(["-", " ", "_"]).join(words)
        attr = f" {self.r.choice(['class', 'class', 'id'])}={chr(34)}{value}{chr(34)}" if named else ""
        mark = "" if label is None else f" data-label={label}"
        return f"<{tag}{attr}{mark}>", f"</{tag}>"

    def around(self, inside: str) -> str:
        for _ in range(self.r.randint(0, 2)):
            name = f" class='{self.r.choice(AROUND)}'" if self.r.random() < 0.7 else ""
            inside = f"<div{name}>{inside}</div>"
        return inside

    def links(self, low: int, high: int) -> str:
        items = [f"<a href='/{self.word()}'>{self.phrase(1, self.r.choice([2, 2, 8]))}</a>" for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.75:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return self.r.choice([" | ", " ", " &middot; "]).join(items)

    def region(self, kind: str) -> str:
        start, end = self.open(kind, label=0)
        r = self.r
        if kind == "nav":
            inside = self.links(2, 9)
        elif kind == "header":
            inside = f"<{(h := r.choice(['h1', 'div', 'p', 'h2', 'div']))}>{self.phrase(1, 3)}</{h}>" + (f"<p>{self.sentence(2, 8)}</p>" if r.random() < 0.4 else "") + (self.region("nav") if r.random() < 0.5 else "") + (self.region("form") if r.random() < 0.2 else "")
        elif kind == "footer":
            inside = r.choice([f"&copy; {r.randint(1999, 2026)} {self.phrase(1, 4)}", f"&copy; {self.word()}.com &middot; {self.sentence(2, 12)}", f"<p>{self.sentence(3, 15)}</p>" * r.randint(1, 2)]) + (self.links(2, 6) if r.random() < 0.6 else "")
        elif kind == "sidebar":
            items = [f"<h{(n := r.randint(2, 4))}>{self.phrase(1, 3)}</h{n}>{r.choice([self.links(2, 6), f'<p>{self.sentence(3, 20)}</p>', f'<p>{self.prose(2)}</p>'])}" for _ in range(r.randint(1, 3))]
            inside = "".join(f"<div>{i}</div>" if r.random() < 0.6 else i for i in items)
        elif kind == "ad":
            inside = r.choice([self.sentence(2, 10), f"{self.sentence()} {self.sentence()}", f"<p>{self.prose(3)}</p>", f"<a href='/ad'>{self.phrase(2, 6)}</a>", f"<span>{self.phrase(1, 1)}</span><p>{self.sentence()}</p><a href='/'>{self.phrase(1, 3)}</a>"])
        elif kind == "notice":
            inside = f"<p>{self.sentence(5, 20)} {self.sentence(3, 10)}</p>" + (f"<a href='/p'>{self.phrase(1, 2)}</a>" if r.random() < 0.5 else "") + ("<button>Ok</button>" if r.random() < 0.6 else "")
            inside = inside if r.random() < 0.6 else f"{self.sentence(4, 20)} <button>Ok</button>"
        elif kind == "form":
            inside = f"<label>{self.phrase(1, 4)}</label><input name=q><button>{self.word()}</button>" + (f"<p>{self.sentence(3, 14)}</p>" if r.random() < 0.5 else "")
            inside = r.choice([inside, f"<p>{self.prose(2)}</p>{inside}", f"<p>{self.sentence()} {self.sentence()}</p><input>"]) if start.startswith("<form") else f"<h3>{self.phrase(2, 5)}</h3><p>{self.sentence(3, 14)}</p><form>{inside}</form>"
        elif kind == "share":
            inside = self.links(2, 5) if r.random() < 0.6 else "".join(f"<span>{self.word()}</span> " for _ in range(r.randint(2, 5)))
        else:
            inside = (f"<h{(n := r.randint(2, 4))}>{r.choice([self.phrase(1, 3), f'{r.randint(1, 90)} {self.word()}'])}</h{n}>" if r.random() < 0.7 and not start.startswith(("<ol", "<ul")) else "") + "".join(self.comment(start) for _ in range(r.randint(1, 5))) + (self.region("form") if r.random() < 0.3 and not start.startswith(("<ol", "<ul")) else "")
        return start + inside + end

    def comment(self, start: str) -> str:
        r = self.r
        tag = "li" if start.startswith(("<ol", "<ul")) else r.choice(["div", "article", "div", "p"])
        name = f" class='{r.choice(['comment', 'reply', 'comment-body', 'item', 'media', 'post'])}'" if r.random() < 0.7 else ""
        who = r.choice([f"<b>{self.phrase(1, 2)}</b> ", f"<span class=author>{self.phrase(1, 2)}</span>: ", f"<cite>{self.phrase(1, 2)}</cite> <time>{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(2001, 2026)}</time> ", ""])
        inside = who + self.prose(3) if tag == "p" or r.random() < 0.4 else f"<div>{who}</div><p>{self.prose(4)}</p>" + (f"<a href='/r'>{self.word()}</a>" if r.random() < 0.4 else "")
        return f"<{tag}{name}>{inside}</{tag}>"

    def blocks(self) -> str:
        """The main text, with what may stand inside it."""
        r, out = self.r, []
        if r.random() < 0.85:
            head = f"<h1>{self.phrase(1, 14)}</h1>"
            own = r.choice(["", "", " class='entry-header'", " class=article-header", " class='post header'"])
            out.append(f"<header{own}>{head}</header>" if r.random() < 0.3 else head)
        for k in range(r.choice([1, 2, 3, 5, 8, 14])):
            kind = r.random()
            if kind < 0.62:
                out.append(f"<p>{self.prose(r.choice([1, 1, 2, 5, 12]))}</p>")
            elif kind < 0.7:
                out.append(f"<p><b>{self.prose(2)}<br>")
            elif kind < 0.78:
                out.append(f"<h{(n := r.randint(2, 4))}>{self.phrase(1, 9)}</h{n}>")
            elif kind < 0.85:
                out.append("<ul>" + "".join(f"<li>{self.prose(2)}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
            elif kind < 0.88:
                out.append(f"<blockquote>{r.choice(['', '<p>'])}{self.prose(4)}</blockquote>")
            elif kind < 0.9:
                out.append(f"<pre>{self.word()}({r.randint(0, 99)})\n  {self.word()} = {self.word()}</pre>")
            elif kind < 0.92:
                out.append("<table>" + "".join(f"<tr>{''.join(f'<td>{r.choice([self.phrase(1, 3), str(r.randint(0, 9999))])}</td>' for _ in range(3))}</tr>" for _ in range(r.randint(1, 5))) + "</table>")
            elif kind < 0.94:
                out.append(f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>")
            elif kind < 0.95:
                out.append(f"<section><h2>{self.phrase(1, 6)}</h2><p>{self.prose(5)}</p></section>")
            elif kind < 0.96:
                out.append(f"<div>{self.prose(5)}</div>")
            elif k:
                out.append(self.region(r.choice(["ad", "share", "form", "sidebar", "notice"])))
        if r.random() < 0.12:
            out.append(self.region(r.choice(["share", "comments", "form", "nav"])))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        if r.random() < 0.03:
            return f"<p data-label=1>{self.prose(5)}</p>" if r.random() < 0.5 else self.prose(5)
        start, end = self.open("content", label=1)
        main = start + self.blocks() + end
        if r.random() < 0.06:  # nothing around the main text but the body
            main = f"<div data-label=1>{self.blocks()}</div>"
        before = [self.region(k) for k, p in (("notice", 0.25), ("header", 0.5), ("nav", 0.75), ("ad", 0.4), ("form", 0.1)) if r.random() < p]
        after = [self.region(k) for k, p in (("share", 0.2), ("comments", 0.35), ("sidebar", 0.45), ("ad", 0.2), ("nav", 0.1), ("form", 0.12), ("footer", 0.8), ("notice", 0.12)) if r.random() < p]
        if r.random() < 0.12:  # columns of a table
            side = self.links(2, 8)
            main = f"<table><tr><td data-label=0>{side}</td><td data-label=1>{self.blocks()}</td></tr></table>"
        if r.random() < 0.25 and after:
            main = f"<main>{main}{after.pop(0)}</main>"
        middle = self.around(main)
        if r.random() < 0.2:
            k = r.randint(0, len(after))
            middle, after = self.around(middle + "".join(after[:k])), after[k:]
        return f"<html><head><title>{self.phrase(1, 5)}</title><script>var a='<p>';</script></head><body>{self.around(''.join(before))}{middle}{self.around(''.join(after))}</body></html>"


def labelled_pages(n: int, seed: int = 1) -> list[str]:
    return [Maker(seed * 1_000_003 + k).page() for k in range(n)]
