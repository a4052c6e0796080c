"""Labelled pages for the block labeller: sampled pages that mark their article, and layouts drawn at random."""

from __future__ import annotations

import random
from html import escape

from quillstone.llm.html_blocks import Leaf, Node, leaves

# Names that pages give to what is and is not main text.
MAIN = frozenset("article main".split())
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog button select head title figcaption".split())
ASIDE_NAMES = (
    "ad ads advert advertisement banner promo sponsored nav navbar menu breadcrumb breadcrumbs sidebar aside widget footer masthead cookie consent notice"
    " popup modal alert newsletter subscribe signup form login search share social related recommended comments comment reply replies disqus discussion respond hidden tags pagination"
).split()
COMMON_NAMES = "ad ads advert banner promo notice cookie sidebar related share".split()
#: Names that an article may have on its own element, though others give them to what is none.
OWN_NAMES = "social share tags tag widget post entry item reply hidden related search featured sponsored".split()
#: Names of comment sections beside the usual ones; half of the sections that are drawn have names of letters at random.
COMMENT_NAMES = "comments discussion replies reactions responses feedback opinions voices thread guestbook readers".split()
#: For private use; taken out of the texts first.
MARKS = ("\ue000", "\ue001")
MAIN_NAMES = "content main article post entry story body text maincontent primary page".split()


def weak_labels(page: list[Leaf]) -> list[bool] | None:
    """Main or not, by the elements above each block; None if the page marks no article."""
    known: dict[Node | None, bool | None] = {None: None}  # None: outside of any article and aside

    def inside(node: Node | None) -> bool | None:
        ways = []
        while node not in known:
            ways.append(node)
            node = node.parent
        found = known[node]
        for own in reversed(ways):
            tag, *names = own.element.split()
            if tag in MAIN and found is None:
                found = True
            elif tag in ASIDE_TAGS or {n[1:] for n in names} & set(ASIDE_NAMES):
                found = False
            known[own] = found
        return found

    out = [inside(leaf.node) for leaf in page]
    return [x is True for x in out] if True in out else None


def dressed(rng: random.Random, name: str) -> str:
    """A class or id with a name in it."""
    shape = rng.choice(["{}", "{}", "{}", "{}", "{}", "{}-box", "site-{}", "page-{}", "{}-wrapper", "block {}", "{}s", "l-{}", "{}_area"])
    return f'{rng.choice(["class", "class", "id"])}="{shape.format(name)}"'


def words_of(texts: list[str]) -> list[str]:
    """The texts whose words layouts are drawn with, without the marks; their words are told apart as they are drawn, so long texts take no more space."""
    return [text.translate(dict.fromkeys(map(ord, MARKS))) for text in texts]


def odd_name(rng: random.Random) -> str:
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9)))


def layout(rng: random.Random, main: list[str], other: list[str]) -> tuple[list[Leaf], list[bool]]:
    """A page of these texts' words: marks in the texts tell its main blocks from the others after parsing."""
    mark_main, mark_other = MARKS

    def text(given: list[str], mark: str) -> str:
        words = rng.choice(given).split() or ["x"]
        size = rng.choice([1, 2, 3, 6, 15, len(words)])
        begin = rng.randint(0, max(0, len(words) - size))  # anywhere in the text
        # blocks may begin with elements that have no text
        return rng.choice([""] * 7 + ["<br>", "<img src='x'>", "<span></span>"]) + mark + escape(" ".join(words[begin : begin + size]))

    def remarks() -> str:
        """What readers say, told by names or by its form alone: items that repeat, each often with who says it first."""
        t = lambda: text(other + main, mark_other)
        name, item = (odd_name(rng), odd_name(rng)) if rng.random() < 0.4 else (rng.choice(COMMENT_NAMES), rng.choice(["comment", "reply", "response", "reaction", "message"]))
        tag = rng.choice(["div", "section", "ol", "ul"])
        own = "li" if tag in ("ol", "ul") else rng.choice(["div", "div", "article"])
        who = rng.choice(["", "<b>{}</b>", "<strong>{}</strong>", "<p class=author>{}</p>", "<span>{}</span>"])
        heading = rng.choice(["", f"<h2>{t()}</h2>", f"<h3>{t()}</h3>"])
        items = "".join(f"<{own} {rng.choice(['class', 'class', 'id'])}={item}>{who.format(text(other, mark_other))}<p>{t()}</p></{own}>" for _ in range(rng.randint(1, 5)))
        return f"<{tag} {dressed(rng, name)}>{heading}{items}</{tag}>"

    def aside() -> str:
        def t() -> str:
            return text(other + main * rng.randint(0, 1), mark_other)

        def link() -> str:
            return f'<a href="#">{t()}</a>'

        kind = rng.randrange(11)
        if kind == 0:
            return f"<{(tag := rng.choice(['nav', 'div ' + dressed(rng, 'menu'), 'div ' + dressed(rng, 'nav')]))}><ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8))) + f"</ul></{tag.split()[0]}>"
        if kind == 1:
            return f"<header>{rng.choice(['<h1>', '<p>', '<div>'])}{t()}</header>"
        if kind == 2:
            return f"<footer><p>{t()}</p>{rng.choice(['', link()])}</footer>"
        if kind == 3:
            return f"<aside {dressed(rng, rng.choice(['sidebar', 'widget', 'related']))}><h3>{t()}</h3><p>{t()}</p></aside>"
        if kind == 4:
            return f"<form><label>{t()}</label><input><p>{t()}</p><button>{t()}</button></form>"
        if kind == 5:
            heading = rng.choice(["", f"<h2>{t()}</h2>"])
            name = rng.choice(["comments", "discussion", "replies"])
            return f"<{(tag := rng.choice(['div', 'section', 'ol']))} {dressed(rng, name)}>{heading}" + "".join(f'<{(own := rng.choice(["div", "li", "article"]))} class="comment">{rng.choice(["", "<b>" + t() + "</b>"])}<p>{t()}</p></{own}>' for _ in range(rng.randint(1, 4))) + f"</{tag}>"
        if kind == 6:  # a form of another make
            return f"<form {dressed(rng, 'form')}><fieldset><legend>{t()}</legend><p>{t()}</p><div><label>{t()} <input type=checkbox> {t()}</label></div></fieldset>{t()}</form>"
        if kind == 7:  # sections at the top and the bottom of an article
            tag = rng.choice(["header", "footer", "nav", "aside"])
            return f"<{tag}>{t()}{rng.choice(['', '<p>' + t() + '</p>', '<div>' + t() + '</div>', link()])}</{tag}>"
        name = rng.choice(COMMON_NAMES if rng.random() < 0.5 else ASIDE_NAMES)
        inner = rng.choice([t, lambda: f"<p>{t()}</p>", lambda: f"<p>{t()}</p><p>{t()}</p>", lambda: f"<h3>{t()}</h3><ul><li>{link()}</li><li>{link()}</li></ul>"])()
        tag = rng.choice(["div", "div", "section", "p" if "<" not in inner.replace("<a", "") else "div"])
        return f"<{tag} {dressed(rng, name)}>{inner}</{tag}>"

    def block(k: int) -> str:
        t = text(main, mark_main)
        if k == 0 and rng.random() < 0.7:
            return rng.choice(["<h1>{}</h1>"] * 3 + ["<h2>{}</h2>", f"<{(h := rng.choice(['h1', 'h2']))} class='{rng.choice(MAIN_NAMES)}-title'>{{}}</{h}>"]).format(t)
        return rng.choice(["<p>{}</p>"] * 8 + ["<p><b>{}<br>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<div>{}</div>", "<p><a href='#'>{}</a></p>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>"]).format(t)

    blocks = [block(k) for k in range(rng.randint(1, 14))]
    if len(blocks) > 1 and rng.random() < 0.25:  # all but the heading in an element of their own
        blocks[1:] = [f"<div {dressed(rng, rng.choice(MAIN_NAMES))}>", *blocks[1:], "</div>"]
    for _ in range(rng.choice([0, 1, 2, 3])):
        blocks.insert(rng.randint(1, len(blocks)), aside())
    named = [f'article class="{rng.choice(["post", "entry", "story", "item"])} {rng.choice(OWN_NAMES)}"', f'article class="{rng.choice(OWN_NAMES)}"']
    tag = rng.choice(["article"] * 3 + named + ["main"] * 2 + ["div " + dressed(rng, rng.choice(MAIN_NAMES)), "section " + dressed(rng, rng.choice(MAIN_NAMES)), "div", "div", ""])
    body = f"<{tag}>{''.join(blocks)}</{tag.split()[0]}>" if tag else "".join(blocks)
    if rng.random() < 0.3:
        body += remarks()
    if rng.random() < 0.3:
        body = f"<main>{body}</main>" if tag != "main" else f"<div class='container'>{body}</div>"
    before, after = ("".join(aside() for _ in range(rng.randint(0, 4))) for _ in range(2))
    if rng.random() < 0.3:  # wrapped once more
        body, after = f"<div {dressed(rng, rng.choice(['wrapper', 'page', 'container', 'layout']))}>{before}{body}{after}</div>", ""
        before = ""
    page = f"<html><head><title>{text(main, mark_other)}</title></head><body>{before}{body}{after}{rng.choice(['</body></html>', ''])}"
    found = leaves(page)
    labels = [mark_main in leaf.text and mark_other not in leaf.text for leaf in found]
    for leaf in found:
        leaf.text = leaf.text.replace(mark_main, "").replace(mark_other, "") or "x"
    return found, labels


def training_pages(pages: list[str], drawn: int, seed: int = 6) -> list[tuple[list[Leaf], list[bool]]]:
    """The pages that mark their article, and ``drawn`` layouts of their texts."""
    rng = random.Random(seed)
    known = [(p, own) for p in map(leaves, pages) if (own := weak_labels(p))]
    main = words_of([leaf.text for p, own in known for leaf, x in zip(p, own) if x] or ["some words of a text", "more of them, and an end."])
    other = words_of([leaf.text for p, own in known for leaf, x in zip(p, own) if not x] or ["Home", "About us", "All rights reserved."])
    return known + [layout(rng, main, other) for _ in range(drawn)]
