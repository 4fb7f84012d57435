"""Labelled pages to learn from: layouts whose blocks carry ``data-label``
("1": main text, "0": anything else; blocks inside inherit it).

Layouts are drawn by a seeded generator from the parts that web pages have, so
the marks of main text (article, main, content ...) and of the rest (menus,
adverts, notices, comments ...) occur in many combinations, with and without
tags that name them.  A share ``INVENTED`` of the labelled parts is a plain ``div``
with a name that means nothing, so that size, links and the name's mere presence
count too: pages name their parts in any language.
"""

from __future__ import annotations

import random

#: fixed values: names that pages give to their parts
MAIN = [("article", ""), ("main", ""), ("div", "content"), ("div", "main-content"), ("div", "post-body"), ("section", "article-body"), ("div", "entry-content"), ("div", "story-text"),
        ("article", "post"), ("div", "article"), ("td", "content")]
WRAP = [("div", "page"), ("div", "container"), ("div", "wrapper"), ("main", "main"), ("div", ""), ("div", "site row"), ("section", ""), ("div", "col layout")]
MENU = [("nav", ""), ("nav", "navbar menu"), ("div", "menu"), ("ul", "nav"), ("div", "breadcrumb"), ("div", "navigation"), ("div", "pagination pager"), ("div", "toc links"), ("div", "tags")]
TOP = [("header", ""), ("div", "header"), ("header", "site-header masthead"), ("div", "topbar"), ("div", "banner"), ("div", "logo brand")]
BOTTOM = [("footer", ""), ("div", "footer"), ("footer", "site-footer"), ("div", "copyright legal"), ("div", "bottom colophon")]
SIDE = [("aside", ""), ("div", "sidebar"), ("aside", "widget"), ("div", "related"), ("section", "related-posts recommended"), ("div", "popular trending"), ("div", "author bio"), ("div", "teaser more")]
NOTICE = [("div", "cookie-notice"), ("div", "cookie consent banner"), ("div", "alert notice"), ("div", "gdpr privacy popup"), ("div", "modal overlay"), ("section", "notice message warning"), ("div", "paywall subscribe"),
          ("div", "newsletter signup"), ("dialog", "")]
ADVERT = [("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("div", "sponsor sponsored"), ("div", "promo"), ("section", "promotion"), ("aside", "ad"), ("div", "banner-ad"), ("div", "adsense")]
FORM = [("form", ""), ("form", "search"), ("div", "login form"), ("form", "comment-form"), ("fieldset", ""), ("button", ""), ("div", "share social"), ("select", "")]
COMMENT = [("div", "comments"), ("section", "comments"), ("ol", "comment-list"), ("div", "comment"), ("div", "replies discussion"), ("section", "responses"), ("div", "disqus thread"), ("ul", "user-comments reviews")]

INVENTED = 0.1


class Pages:
    def __init__(self, seed: int):
        self.r, self.invent = random.Random(seed), random.Random(seed + 1)

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high))).capitalize()

    def element(self, tag: str, name: str, inner: str, label: str | None = None) -> str:
        if label and self.invent.random() < INVENTED:
            if tag in ("aside", "nav", "header", "footer", "article", "main", "section"):
                tag = "div"
            name = "".join(self.invent.choice("abcdefghilmnoprstu") for _ in range(7))
        attr = self.r.choice(["class", "class", "id"])
        mark = (f' {attr}="{name}"' if name else "") + (f' data-label="{label}"' if label else "")
        return f"<{tag}{mark}>{inner}</{tag}>"

    def paragraph(self) -> str:
        r = self.r
        text = self.words(1, 4) + "." if r.random() < 0.15 else ". ".join(self.words(4, 25) for _ in range(r.randint(1, 5))) + r.choice([".", ".", "", "!"])
        if r.random() < 0.2:
            text += f' <a href="/x">{self.words(1, 3)}</a> {self.words(2, 8)}.'
        kind = r.random()
        if kind < 0.06:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.1:
            return "<ul>" + "".join(f"<li>{self.words(1, 12)}</li>" for _ in range(r.randint(2, 4))) + "</ul>"
        if kind < 0.14:
            return f"<h{r.randint(2, 4)}>{self.words(1, 6)}</h2><p>{text}</p>"
        if kind < 0.16:
            return f"<pre>{text}</pre>"
        if kind < 0.19:
            return "<table><tr><td>" + "</td><td>".join(self.words(1, 5) for _ in range(3)) + "</td></tr></table>"
        if kind < 0.23:
            return f"<p><b>{text}<br>"
        if kind < 0.28:
            return f"<div>{text}</div>"
        return f"<p>{text}</p>"

    def other(self, kinds: list) -> str:
        r = self.r
        tag, name = r.choice(kinds)
        if kinds is MENU or (kinds in (SIDE, BOTTOM, TOP) and r.random() < 0.4):
            items = [f'<a href="/y">{self.words(1, 3)}</a>' for _ in range(r.randint(2, 8))]
            inner = "<li>" + "</li><li>".join(items) + "</li>" if tag in ("ul", "ol") else "<ul><li>" + "</li><li>".join(items) + "</li></ul>" if r.random() < 0.7 else " | ".join(items)
        elif kinds is COMMENT:
            inner = "".join(f'<{"li" if tag in ("ul", "ol") else "div"} class="{r.choice(["comment", "reply", "message", ""])}"><p>{self.words(2, 30)}.</p></{"li" if tag in ("ul", "ol") else "div"}>' for _ in range(r.randint(1, 4)))
        elif kinds is FORM:
            inner = f"<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>" if tag != "button" else self.words(1, 3)
        else:
            inner = "".join(r.choice(["<p>{}</p>", "{}", "<h3>{}</h3>", "<div>{}</div>"]).format(self.words(1, 25) + r.choice([".", "", "!"])) for _ in range(r.randint(1, 3)))
            if kinds is BOTTOM and r.random() < 0.6:
                inner = "&copy; " + inner
        return self.element(tag, name, inner, "0")

    def page(self) -> str:
        r = self.r
        tag, name = r.choice(MAIN) if r.random() < 0.6 else MAIN[0]
        body = ([f"<h1>{self.words(2, 10)}</h1>"] if r.random() < 0.8 else []) + [self.paragraph() for _ in range(r.randint(1, 10))]
        for kinds, share in ((ADVERT, 0.25), (SIDE, 0.1), (COMMENT, 0.12), (FORM, 0.08), (NOTICE, 0.08), (MENU, 0.08), (BOTTOM, 0.03), (TOP, 0.03)):
            if r.random() < share:
                body.insert(r.randint(1, len(body)), self.other(kinds))
        main = self.element(tag, name, "".join(body), "1")
        before = [self.other(k) for k in (TOP, MENU, ADVERT, NOTICE, FORM, SIDE) if r.random() < 0.45]
        after = [self.other(k) for k in (ADVERT, SIDE, COMMENT, FORM, BOTTOM, NOTICE, MENU) if r.random() < 0.45]
        page = "".join([*before, main, *after])
        for _ in range(r.randint(0, 2)):
            page = self.element(*r.choice(WRAP), page)
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title></head><body>{page}</body></html>"


def labelled_pages(n: int, seed: int = 11) -> list[str]:
    g = Pages(seed)
    return [g.page() for _ in range(n)]
