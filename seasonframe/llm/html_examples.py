"""Generated training pages: many layouts around invented articles, with the label of every block."""

from __future__ import annotations

import numpy as np

from seasonframe.llm.html_blocks import Block

# Names that sites give to the parts of a page, by kind.
ARTICLE = "article content main post entry story body text page-content post-content entry-content article-body story-body main-content blog-post post-body articlebody copy prose".split()
PARTS = {
    "menu": ("nav ul div", "nav menu navbar navigation main-menu breadcrumb breadcrumbs topnav tabs pagination toc"),
    "header": ("header div", "header site-header masthead banner top-bar branding logo page-header"),
    "footer": ("footer div", "footer site-footer bottom copyright colophon legal page-footer"),
    "sidebar": ("aside div", "sidebar side widget related recommended trending most-read popular right-rail related-posts"),
    "notice": ("div section aside", "notice cookie cookie-banner cookie-notice consent gdpr alert newsletter subscribe popup modal paywall disclaimer"),
    "advert": ("div ins section aside", "ad ads advert advertisement sponsor sponsored promo banner-ad ad-slot ad-container"),
    "form": ("form div", "form search search-form login signup contact-form subscribe-form"),
    "comments": ("section div ol", "comments comment comment-list discussion replies respond reader-comments user-comments responses"),
    "share": ("div ul", "share social sharing follow share-buttons author-box tags"),
}
PHRASES = {
    "menu": "Home|About us|Contact|News|Products|Blog|Archive|Login|Next page|Previous",
    "header": "Daily News|Welcome to our site|Menu|Search|Skip to content",
    "footer": "© 2024 All rights reserved|Privacy policy|Terms of use|Powered by a website builder|Contact us",
    "sidebar": "Related articles|Most read|You may also like|Popular posts|Categories|Recent posts",
    "notice": "We use cookies to improve your experience. Accept all cookies?|Subscribe to our newsletter|This site uses cookies.|Please enable JavaScript",
    "advert": "Advertisement|Sponsored content|Buy now and save|Special offer|Limited time only",
    "form": "Your name|E-mail address|Search|Password|Send|Your message",
    "comments": "Leave a reply|3 comments|Anonymous says:|Reply|Great article, thank you!|Posted by a reader",
    "share": "Share on social media|Tweet|Follow us|Print|E-mail this",
}
SYLLABLES = "an be co da en er es fi go ha in is ka li lo ma ne no on or pa re ri se st ta th to un ve".split()

_LAYOUT_TAGS = ("article", "main")
_WEAK = {w for tags, names in PARTS.values() for n in names.split() for w in n.split("-")} - {"main", "page", "content", "site", "body", "posts", "post", "top", "box", "list", "most", "user", "right", "reader", "author", "container", "slot", "text"}


def weak_label(block: Block) -> int:
    """1 or 0 where the tags and names above a block say so, else -1."""
    path = set(block.path)
    if path & {"nav", "footer", "aside", "form"} or path & {f".{w}" for w in _WEAK}:
        return 0
    return 1 if path & {"article", "main", *(f".{w}" for n in ARTICLE for w in n.split("-"))} else -1


def example_pages(sentences: list[str], n: int = 900, seed: int = 9) -> list[str]:
    """HTML pages whose elements carry data-label; text is made of the given sentences and of invented ones."""
    rng = np.random.default_rng(seed)
    pool = [s for s in sentences if len(s) > 20][:2000]

    def pick(values):
        return values[int(rng.integers(len(values)))]

    def word() -> str:
        return "".join(pick(SYLLABLES) for _ in range(int(rng.integers(1, 4))))

    def sentence() -> str:
        if pool and rng.random() < 0.6:
            words = pick(pool).split()
            s = int(rng.integers(max(1, len(words) - 5)))
            return " ".join(words[s:s + int(rng.integers(5, 40))]).replace("&", "&amp;").replace("<", "&lt;")
        return " ".join(word() for _ in range(int(rng.integers(4, 25)))).capitalize() + pick(".…!?.")

    def paragraph() -> str:
        out = " ".join(sentence() for _ in range(int(rng.integers(1, 5))))
        if rng.random() < 0.2:
            out = f'{out} <a href="/{word()}">{word()} {word()}</a> {sentence()}'
        return f"<b>{out}</b>" if rng.random() < 0.05 else out

    def short() -> str:
        return " ".join(word() for _ in range(int(rng.integers(1, 5))))

    def named(names: str | list[str], chance: float) -> str:
        values = names.split() if isinstance(names, str) else names
        noise = f" {word()}-{word()}" if rng.random() < 0.25 else ""
        if rng.random() < chance:
            return f' {pick(("class", "class", "id"))}="{pick(values)}{noise}"'
        return f' class="{noise.strip()}"' if noise else ""

    def part(kind: str) -> str:
        tags, names = PARTS[kind]
        tag = pick(tags.split())
        # A plain element says what it is by its name; telling tags may go without.
        attributes = named(names, 0.4 if tag in ("nav", "header", "footer", "aside", "form") else 1.0)
        inner = []
        for _ in range(int(rng.integers(1, 7))):
            prose = rng.random() < (0.75 if kind in ("comments", "sidebar", "advert", "notice", "footer") else 0.1)
            text = pick(PHRASES[kind].split("|")) if rng.random() < 0.3 else paragraph() if prose else short()
            if kind in ("menu", "sidebar", "share", "header", "footer") and not prose and rng.random() < 0.8:
                text = f'<a href="/{word()}">{text}</a>'
            shape = pick(("p", "li", "div", "h3", "span", "")) if kind != "menu" else pick(("li", "li", "div", "span"))
            if kind == "comments" and rng.random() < 0.5:
                shape = pick(("article", "li", "div"))
                text = f"<p>{text}</p>"
            if kind == "form" and rng.random() < 0.6:
                text = f"<label>{text}</label><input name={word()}>"
            inner.append(f"<{shape}>{text}</{shape}>" if shape else text)
        joined = "".join(inner)
        if tag in ("ul", "ol"):
            joined = "".join(f"<li>{x}</li>" for x in inner)
        elif "<li>" in joined and rng.random() < 0.8:
            joined = f"<ul>{joined}</ul>"
        return f'<{tag}{attributes} data-label="0">{joined}</{tag}>'

    def body_block() -> str:
        kind = rng.random()
        if kind < 0.68:
            return f"<p{named('lead intro para', 0.05)}>{paragraph()}" + ("</p>" if rng.random() < 0.9 else "<br>")
        if kind < 0.78:
            h = pick(("h2", "h2", "h3", "h4"))
            return f"<{h}>{short().capitalize()}</{h}>"
        if kind < 0.86:
            items, tag = "".join(f"<li>{pick((sentence, short))()}" for _ in range(int(rng.integers(2, 6)))), pick(("ul", "ol"))
            return f"<{tag}>{items}</{tag}>"
        if kind < 0.90:
            return f"<blockquote>{paragraph()}</blockquote>"
        if kind < 0.93:
            return f"<table><tr><td>{short()}</td><td>{sentence()}</td></tr></table>"
        if kind < 0.96:
            return f"<figure><img src=x.png><figcaption>{sentence()}</figcaption></figure>"
        tag = pick(("pre", "div", "div", "section"))
        return f"<{tag}>{paragraph()}</{tag}>"

    pages = []
    for _ in range(n):
        inside = [f"<h1>{sentence()}</h1>"] if rng.random() < 0.85 else []
        if inside and rng.random() < 0.15:
            inside = [f"<header>{inside[0]}</header>"]
        for _ in range(int(rng.integers(1, 14))):
            inside.append(body_block())
            if rng.random() < 0.07:
                inside.append(part(pick(("advert", "sidebar", "share", "notice", "form"))))
        # Some sites keep page furniture inside the article's element.
        if rng.random() < 0.15:
            inside.insert(0, part(pick(("menu", "header", "notice", "share"))))
        if rng.random() < 0.2:
            inside.append(part(pick(("comments", "comments", "footer", "sidebar", "form"))))
        article = "".join(inside)
        depth = int(rng.integers(1, 4))
        for level in range(depth):
            tag, mark = pick(("article", "main", "div", "div", "section")), "" if level else ' data-label="1"'
            article = f"<{tag}{named(ARTICLE, 0.9 if tag in ('div', 'section') else 0.3)}{mark}>{article}</{tag}>"
        before = [part(k) for k in ("notice", "header", "menu", "advert", "form", "menu") if rng.random() < 0.5]
        after = [part(k) for k in ("share", "comments", "sidebar", "advert", "form", "notice", "footer") if rng.random() < 0.45]
        rng.shuffle(before)
        if rng.random() < 0.3:
            rng.shuffle(after)
        side = [part("sidebar")] if rng.random() < 0.2 else []
        inner = "".join([*before, *side, article, *after])
        if rng.random() < 0.4:
            inner = f'<div{named("wrapper page container site layout", 0.8)}>{inner}</div>'
        pages.append(f"<!DOCTYPE html><html><head><title>{short()}</title><script>var a='</p>';</script></head><body>{inner}</body></html>")
    return pages
