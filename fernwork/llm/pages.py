"""Labelled training pages: layouts put together from pieces whose part in the page is known.

Texts come from pages of the table; layouts, class names and the phrases of
menus, notices and forms are drawn with a seed. A block is labelled 1 if it
belongs to the article.
"""

from __future__ import annotations

import random

# Wrappers of the article, and of what isn't part of it.
ARTICLE = ["<article>", "<article>", "<article>", "<main>", "<main>", "<article class='post'>", "<main id='main'>", "<div class='content'>", "<div id='content'>", "<div class='article-body'>", "<div class='post-content entry'>", "<section class='entry-content'>", "<div class='story'>", "<div itemprop='articleBody'>", "<div class='text'>", "<div>", "<section>", "<div role='main'>"]
MENU = ["<nav>", "<div class='menu'>", "<div id='navigation'>", "<ul class='nav'>", "<nav class='navbar'>", "<div class='breadcrumbs'>", "<div class='topbar'>", "<nav role='navigation'>", "<div class='pagination'>", "<div class='toc'>"]
HEADER = ["<header>", "<div class='header'>", "<div id='masthead'>", "<div class='site-header'>", "<header class='banner'>", "<div class='logo'>"]
FOOTER = ["<footer>", "<div class='footer'>", "<div id='footer'>", "<footer class='site-footer'>", "<div class='copyright'>", "<div class='bottom legal'>"]
SIDE = ["<aside>", "<div class='sidebar'>", "<div id='sidebar'>", "<aside class='widget'>", "<div class='related'>", "<div class='popular-posts'>", "<div class='widget recent'>", "<section class='recommended'>", "<div class='tags'>", "<div class='trending'>", "<div class='author-box'>"]
NOTICE = ["<div class='cookie'>", "<div class='cookie-notice'>", "<div id='consent'>", "<div class='notice'>", "<div class='alert'>", "<div class='popup modal'>", "<div class='newsletter'>", "<div role='dialog'>", "<div class='subscribe'>", "<div class='gdpr banner'>", "<div class='paywall'>", "<div class='disclaimer'>"]
ADVERT = ["<div class='ad'>", "<div class='ads'>", "<div class='advert'>", "<div class='advertisement'>", "<div class='sponsored'>", "<aside class='ad'>", "<div class='promo'>", "<div id='banner-ad'>", "<div class='share social'>", "<div class='sharing'>"]
FORM = ["<form>", "<form class='search'>", "<form id='login'>", "<div class='search-form'>", "<form class='signup'>", "<fieldset>", "<form class='contact'>"]
COMMENT = ["<div class='comments'>", "<section id='comments'>", "<ol class='commentlist'>", "<div class='comment'>", "<div id='disqus_thread'>", "<div class='reader-comments'>", "<section class='responses'>", "<div class='replies'>", "<ul class='discussion'>", "<div class='user-comments'>"]

PHRASES = {
    "menu": ["Home", "About", "Contact", "News", "Blog", "Products", "Archive", "Next", "Previous", "Sports", "Accueil", "Startseite", "Inicio", "Kontakt"],
    "footer": ["© 2023 All rights reserved", "© example.com · Privacy", "Privacy policy", "Terms of service", "Imprint", "Alle Rechte vorbehalten", "Mentions légales", "Copyright 2021 Example Inc."],
    "notice": ["We use cookies to improve your experience.", "Accept all cookies", "Subscribe to our newsletter", "This site uses cookies. Learn more", "Sign up for free", "You have read all free articles this month.", "Nous utilisons des cookies", "Wir verwenden Cookies"],
    "advert": ["Advertisement", "Sponsored content", "Buy now and save 50%", "Share on Facebook", "Tweet", "Limited offer", "Anzeige", "Publicité", "Order today"],
    "form": ["Search", "Submit", "Your name", "E-mail", "Password", "Log in", "Message", "Send"],
    "comment": ["Reply", "3 comments", "Leave a comment", "posted 2 hours ago", "Report", "anonymous wrote:", "Show more replies", "Comments"],
    "side": ["Related articles", "Most read", "Recent posts", "Tags", "You may also like", "Trending now", "About the author"],
}
KINDS = {"menu": MENU, "header": HEADER, "footer": FOOTER, "side": SIDE, "notice": NOTICE, "advert": ADVERT, "form": FORM, "comment": COMMENT}


def close(opening: str) -> str:
    return f"</{opening[1:].split()[0].rstrip('>')}>"


def plain(opening: str, r: random.Random) -> str:
    """Now and then the element without its marks, or with others, so that text and place have a say too."""
    tag = opening[1:].split()[0].rstrip(">")
    x = r.random()
    return f"<{tag}>" if x < 0.08 else f"<{tag} class='x{r.randrange(99)}'>" if x < 0.11 else opening


class Maker:
    def __init__(self, sentences: list[str], seed: int):
        self.r = random.Random(seed)
        self.sentences = sentences or ["This is a plain sentence of some length, for want of others."]
        self.parts: list[str] = []
        self.labels: list[int] = []

    def put(self, opening: str, text: str, label: int) -> None:
        self.parts.append(f"{opening}{text}{close(opening)}")
        self.labels.append(label)

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(self.sentences) for _ in range(self.r.randint(low, high)))

    def link(self) -> str:
        return f"<a href='/x'>{self.r.choice([*PHRASES['menu'], self.r.choice(self.sentences)[:30].strip() or 'more'])}</a>"

    def boilerplate(self, kind: str, inside: bool = False) -> None:
        """``inside`` an article only its marks or its element tell it apart, so they stay."""
        r = self.r
        outer = r.choice(KINDS[kind]) if inside else plain(r.choice(KINDS[kind]), r)
        if kind in ("footer", "notice", "advert", "header", "comment", "side") and r.random() < 0.35:  # text of its own
            own = r.choice(PHRASES.get(kind, PHRASES["menu"]))
            if kind == "footer" and r.random() < 0.6:
                own = f"{r.choice(['©', '&copy;', 'Copyright', ''])} {r.choice(['example.com', 'www.site.org', 'Example Inc.'])} {r.choice(['·', '-', '|', '2022'])} "
            self.put(outer, r.choice([own, f"{own} {self.prose(1, 1)}", self.prose(1, 2)]) if kind != "header" else own, 0)
            return
        self.parts.append(outer)
        for _ in range(r.randint(1, 6)):
            if kind in ("menu", "header") or kind == "side" and r.random() < 0.6:
                self.put(r.choice(["<li>", "<li>", "<p>", "<div>"]), self.link(), 0)
            elif kind == "comment" and r.random() < 0.7:
                self.put(r.choice(["<p>", "<li>", "<div>", "<p>"]), self.prose(1, 3), 0)
            elif kind == "advert" and r.random() < 0.5 or kind in ("side", "footer", "notice") and r.random() < 0.3:
                self.put(r.choice(["<p>", "<div>", "<span>"]) if kind == "footer" else r.choice(["<p>", "<div>"]), self.prose(1, 2), 0)
            elif kind == "form":
                self.put(r.choice(["<label>", "<button>", "<p>", "<div>"]) if r.random() < 0.1 else r.choice(["<p>", "<div>", "<button>", "<legend>"]), r.choice(PHRASES["form"]), 0)
            else:
                self.put(r.choice(["<p>", "<div>", "<h3>", "<h4>"]), r.choice(PHRASES.get(kind, PHRASES["menu"])), 0)
        self.parts.append(close(outer))

    def article(self) -> None:
        r = self.r
        outer = plain(r.choice(ARTICLE), r) if r.random() < 0.92 else ""
        self.parts.append(outer)
        if r.random() < 0.85:
            self.put("<h1>", r.choice(self.sentences)[: r.randint(20, 90)].strip() or "Title", 1)
        for _ in range(r.choice([1, 2, 3, 4, 6, 8, 12, 16])):
            x = r.random()
            if x < 0.62:
                self.put("<p>", self.prose(1, 6), 1)
            elif x < 0.70:
                self.put(r.choice(["<h2>", "<h3>"]), r.choice(self.sentences)[:50].strip() or "Part", 1)
            elif x < 0.78:
                self.parts.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    self.put("<li>", self.prose(1, 1), 1)
                self.parts.append("</ul>")
            elif x < 0.82:
                self.put(r.choice(["<blockquote>", "<pre>", "<figcaption>"]), self.prose(1, 2), 1)
            elif x < 0.86:
                self.put("<p>", f"{self.prose(1, 2)} {self.link()} {self.prose(1, 1)}", 1)
            elif x < 0.89:
                self.put("<div>", self.prose(2, 4), 1)
            elif x < 0.90:
                self.put("<p>", r.choice(["This work is licensed under the GNU General Public License.", "Licensed under the MIT License.", "All rights to this story are with its author."]), 1)
            elif x < 0.92:
                words = r.choice(self.sentences).split(" ")
                self.put("<p>", r.choice([" | ".join(words), " ".join([words[0]] * r.randint(3, 40))]), 1)
            elif x < 0.94:
                words = r.choice(self.sentences).split(" ")
                self.put("<p>", " ".join(words[: r.randint(1, 8)]) + r.choice([".", ".", "", ":", " |"]), 1)
            else:
                self.boilerplate(r.choice(["advert", "notice", "side", "form"]), inside=True)
        if r.random() < 0.15:
            self.boilerplate("comment", inside=True)
        self.parts.append(outer and close(outer))

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        self.parts, self.labels = ["<html><body>"], []
        if r.random() < 0.06:  # a page of nothing but text
            self.article()
            return "".join(self.parts), self.labels
        if r.random() < 0.7:
            self.parts[0] = "<html><head>"
            self.put("<title>", r.choice(self.sentences)[:60].strip() or "Title", 0)
            self.parts.append("</head><body>")
        wraps = [r.choice(["<div class='wrapper'>", "<div id='page'>", "<div class='container'>", "<div>", "<div class='row'>"]) for _ in range(r.randint(0, 3))]
        self.parts += wraps
        for kind, share in (("header", 0.5), ("menu", 0.8), ("notice", 0.4), ("advert", 0.5), ("form", 0.25), ("side", 0.2)):
            if r.random() < share:
                self.boilerplate(kind)
        self.article()
        for kind, share in (("comment", 0.45), ("side", 0.5), ("advert", 0.3), ("form", 0.25), ("notice", 0.25), ("menu", 0.15), ("footer", 0.85)):
            if r.random() < share:
                self.boilerplate(kind)
        self.parts += [close(w) for w in reversed(wraps)]
        return "".join(self.parts) + "</body></html>", self.labels
