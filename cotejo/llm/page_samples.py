"""The small labelled table of op 11: pages of our own with the article's blocks marked.

A block whose text begins with MARK belongs to the article; {n} stands for n words of filler. Layouts:
semantic tags, names only, neither, tables, forums, unclosed tags, articles of one line.
"""

from __future__ import annotations

import re

MARK = "✓"

PAGES: list[str] = [
    "<nav><ul><li><a>{1}</a><li><a>{2}</a><li><a>{1}</a></ul></nav><article><h1>{M}{6}</h1><p>{M}{45}<p>{M}{60}<p>{M}{4}<p>{M}{80}</article><footer>{12}</footer>",
    "<header><a>{2}</a><p>{9}</p></header><main><h1>{M}{5}</h1><p>{M}{30}</p><h2>{M}{3}</h2><p>{M}{55}</p><aside><h3>{2}</h3><p>{25}</p></aside><p>{M}{12}</p></main><footer><p>{20}</p></footer>",
    "<div class='nav'><a>{1}</a> <a>{1}</a> <a>{1}</a></div><div class='ad'>{8}</div><article><h1>{M}{7}</h1><p>{M}{10}</p></article><footer>{14}</footer>",
    "<div class='cookie-notice'><p>{28}</p><a>{1}</a></div><div id='content'><h1>{M}{8}</h1><p>{M}{70}</p><p>{M}{35} <a>{3}</a> {20}</p></div><div id='comments'><h3>{1}</h3><p>{30}</p><p>{45}</p><p>{6}</p></div>",
    "<div><a>{2}</a> <a>{2}</a> <a>{1}</a></div><div><h1>{M}{6}</h1><p>{M}{50}</p><p>{M}{5}</p><p>{M}{44}</p><p>{M}{61}</p></div><div><a>{4}</a></div><div><a>{5}</a></div><div>{6}</div>",
    "<div>{3} <a>{1}</a></div><div><div><div>{M}{6}</div><div>{M}{40}</div><div>{M}{33}</div><div>{M}{7}</div><div>{M}{52}</div></div></div><div><a>{3}</a></div><div>{5}</div>",
    "<table><tr><td><a>{2}</a><td><a>{1}</a><td><a>{2}</a></table><table><tr><td><p>{M}{48}</p><p>{M}{66}</p><p>{M}{39}</p></td><td><a>{3}</a><br><a>{4}</a><br><a>{3}</a></td></table><p>{7}",
    "<header class='masthead'><h1>{2}</h1><form><label>{1}</label><p>{3}</p></form></header><section class='story-body'><h1>{M}{9}</h1><p>{M}{25}</p><ul><li>{M}{7}<li>{M}{9}<li>{M}{4}</ul><p>{M}{31}</p></section><section class='related'><h2>{2}</h2><p>{18}</p></section>",
    "<article><header><h1>{M}{4}</h1></header><p>{M}{3}</p></article><div class='comments'><p>{60}</p><p>{80}</p></div>",
    "<article><p>{M}{20}</p><div class='advert'><p>{15}</p></div><p>{M}{28}</p><blockquote>{M}{17}</blockquote><figure><figcaption>{M}{8}</figcaption></figure><ul class='share'><li><a>{1}</a><li><a>{1}</a></ul></article>",
    "<div role='banner'>{5}</div><div role='main'><p>{M}{16}</p><table><tr><th>{M}{1}<th>{M}{2}<tr><td>{M}{1}<td>{M}{3}</table></div><div role='contentinfo'>{11}</div>",
    "<article><h1>{M}{3}</h1><p>{M}{22}</p><h2>{M}{2}</h2><p>{M}{1}</p><ul><li><a>{4}</a><li><a>{5}</a><li><a>{3}</a></ul><p>{M}<a>{6}</a> {14}</p></article><div class='newsletter'><h3>{4}</h3><p>{16}</p></div>",
    "<div class='sidebar'><h3>{1}</h3><p>{40}</p><p>{35}</p></div><div class='post'><h2>{M}{5}</h2><p>{M}{40}</p></div><div class='footer'>{8}</div>",
    "<h1>{M}{5}</h1><p>{M}{37}<p>{M}{41}<p>{M}{29}<p><a>{2}</a> <a>{1}</a>",
    "<p><a>{1}</a> | <a>{1}</a> | <a>{2}</a></p><h2>{M}{6}</h2><p>{M}{90}</p><p>{M}{11}</p><p>{M}{64}</p><hr><p>{3} <a>{2}</a> {1}</p>",
    "<div class='notice'>{30}</div><div>{M}{120}</div><div class='menu'><a>{2}</a></div>",
    "<main><p>{M}{2}</p></main>",
    "<div>{4}</div><article><p>{M}{9}</p></article><div>{9}</div>",
    "<aside>{50}</aside><div class='entry'>{M}{13}</div><div class='promo'>{22}</div>",
    "<nav><a>{1}</a></nav><article><h2>{M}{2}</h2><p>{M}{18}</p><p>{M}{2}</p></article>",
    "<main><h1>{M}{1}</h1><p>{M}{12} <a>{8}</a> {6} <a>{4}</a> {3}</p><p>{M}{9} <a>{6}</a></p><p>{M}{4}</p></main>",
    "<article><p>{M}{1}</p><p>{M}{5}</p></article>",
    "<div><p>{M}{31} <a>{9}</a> {14} <a>{7}</a> {10}</p><p>{M}{28} <a>{12}</a> {5}</p><p>{M}{44}</p></div>",
    "<div>{2}</div><main><p>{M}{3}</p><p>{M}{2}</p><div class='ads'>{5}</div><p>{M}{1}</p></main>",
    "<article><h1>{M}{2}</h1><p>{M}{1} <a>{2}</a> {2}</p></article><p><a>{3}</a></p>",
    "<div class='story'><h3>{M}{2}</h3><p>{M}{2} <a>{3}</a> {3}</p><dl><dt>{M}{1}<dd>{M}{4}</dl></div><div>{1} <a>{2}</a> <a>{2}</a></div>",
    "<article><p>{M}{14}</p><ul><li><a>{2}</a><li><a>{1}</a><li><a>{2}</a></ul><p>{M}{8}</p></article>",
    "<p>{M}{34}",
    "<div><p>{M}{22}</p></div>",
    "<div>{3}</div><div><h1>{M}{4}</h1><p>{M}{19}</p><p>{M}{26}</p></div>",
    "<main><ul><li><a>{3}</a><li><a>{2}</a></ul><p>{M}{7}</p><h2>{M}{3}</h2></main>",
    "<div><a>{2}</a> <a>{1}</a></div><div><h1>{M}{7}</h1></div><div><div><p>{M}{51}</p><p>{M}{30}</p><p>{M}{49}</p></div></div><div><h3>{2}</h3><a>{4}</a></div>",
    "<div>{2}</div><div><h1>{M}{5}</h1></div><div><p>{M}{62}</p><p>{M}{8}</p></div><div><a>{2}</a></div>",
    "<article><h1>{M}{4}</h1><p>{M}{7}</p></article><section class='comments'><h2>{1}</h2><p>{70}</p><p>{40}</p></section>",
    "<article><p>{M}{3}</p></article><div>{7}</div><div>{12}</div><div>{10}</div>",
    "<nav><a>{1}</a></nav><article><div>{M}{4}</div><div>{M}{60}</div><div>{M}{5}</div><div>{M}{90}</div><div>{M}{7}</div></article><div>{6}</div><div>{9}</div>",
    "<div>{5}</div><main><section><h2>{M}{3}</h2><p>{M}{70}</p></section><section><h2>{M}{2}</h2><p>{M}{8}</p></section><section><p>{M}{120}</p></section></main><div>{8}</div><div>{4}</div>",
    "<div>{11}</div><div>{7}</div><article><h1>{M}{5}</h1><div>{M}{12}</div><div>{M}{6}</div></article><div>{14}</div>",
    "<div>{8}</div><div class='content'><div>{M}{10}</div><div>{M}{3}</div><div>{M}{15}</div></div><div>{10}</div>",
    "<nav><a>{2}</a><a>{3}</a></nav><p>{4}</p><div class='ad'>{9}</div><article><p>{M}{75}</p><div class='promo'>{6}</div><p>{M}{58}</p><div class='related'><a>{6}</a> {2}</div><p>{M}{49}</p></article>",
    "<div class='cookies'>{18}</div><div class='nav'>{3} <a>{4}</a></div><div><p>{M}{64}</p><p>{M}{32}</p><div class='ad'>{7}</div><p>{M}{51}</p><p>{M}{30}</p></div><div class='comment'>{44}</div><div class='comment'>{12}</div>",
    "<header><p>{6}</p></header><aside><p>{9}</p></aside><div class='text'><p>{M}{88}</p><p>{M}{40}</p></div><aside><p>{14}</p><p>{33}</p></aside><footer><p>{21}</p><p>{30}</p></footer>",
    "<form><p>{5}</p><p>{8}</p></form><div class='alert notice'>{12}</div><main><p>{M}{47}</p></main><div class='share'>{3}</div><footer>{35}</footer>",
    "<div class='menu'>{4}</div><div class='sidebar'><p>{21}</p></div><div><h1>{M}{6}</h1><p>{M}{53}</p></div><div class='signup'><p>{15}</p></div><div class='footer'><p>{40}</p></div>",
    "<article><p>{M}{12}</p></article><div class='comments'><p>{30}</p><p>{50}</p><p>{40}</p></div><footer>{30}</footer>",
    "<article><p>{M}{15}</p><p>{M}{12} <a>{17}</a></p><p>{M}{9} <a>{14}</a></p><p>{M}{20}</p><ul><li><a>{5}</a><li><a>{4}</a></ul></article>",
    "<div><a>{1}</a></div><div><h1>{M}{3}</h1></div><div><p>{M}{42}</p><p>{M}{38}</p></div>",
    "<div><a>{1}</a><a>{1}</a></div><div><p>{M}{26}</p><p>{M}{24}</p><p>{M}{33}</p><p>{M}{3}</p></div><div><h4>{2}</h4><a>{6}</a><a>{7}</a><a>{5}</a></div>",
]


def pages() -> list[str]:
    """The pages with filler and marks in place."""
    return [re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), p.replace("{M}", MARK)) for p in PAGES]
