"""Pages written by hand, in layouts that the extractor's own generator doesn't have."""

LONG = (
    "The river had risen overnight and the lower fields stood under water, so the farmers moved their animals to the hill before the morning train came in.",
    "By noon the council had met twice, and both times the members agreed that the old bridge should be closed until an engineer had looked at its piers.",
    "Nobody in the village could remember a flood like it, although the church register mentions one in the spring of 1784 that took three houses.",
    "Repairs are expected to take a month; until then, buses will go the long way round by the mill.",
)
SHORT = "“It could have been worse,” the miller said."


def _p(texts):
    return "".join(f"<p>{t}</p>\n" for t in texts)


NEWS = f"""<!doctype html><html lang=en><head><title>Flood - The Valley Post</title><link rel=stylesheet href=a.css>
<script>window.ads = "<article>no</article>";</script></head><body class="home-page has-sidebar">
<a class="skip-link" href="#main">Skip to content</a>
<header class="site-header"><a href="/"><img src="logo.svg" alt="logo"></a><nav class="main-nav" aria-label="Main"><ul><li><a href="/news">News</a><li><a href="/sport">Sport</a><li><a href="/life">Life</a></ul></nav>
<form role="search" class="search-form"><label for=q>Search</label><input id=q><button>Go</button></form></header>
<div class="cookie-banner" role="dialog"><p>We use cookies to improve your visit. Read more in our policy.</p><button>Accept</button></div>
<main id="main"><article class="story"><h1>Bridge closed after night of rain</h1>
{_p(LONG[:2])}<figure><img src=b.jpg><figcaption>The old bridge on Tuesday morning.</figcaption></figure>
<div class="ad-slot"><p>Advertisement: boots for every weather, now at half the price.</p></div>
{_p(LONG[2:])}<p>{SHORT}</p></article>
<section class="comments" id="comments"><h2>2 comments</h2><article class="comment"><p>My cellar is full of water and nobody has come to help, as usual in this valley.</p></article><article class="comment"><p>Same here, we should all write to the council about it.</p></article></section></main>
<aside class="sidebar"><h2>Most read</h2><ol><li><a href=1>Ten walks for dry days</a></li><li><a href=2>The miller's new wheel</a></li></ol></aside>
<footer class="site-footer"><p>&copy; 2024 The Valley Post. All rights reserved.</p><ul><li><a href=t>Terms</a></li><li><a href=c>Contact</a></li></ul></footer></body></html>"""
NEWS_TEXT = "\n".join(["Bridge closed after night of rain", *LONG[:2], "The old bridge on Tuesday morning.", *LONG[2:], SHORT])

BLOG = f"""<html><head><title>A blog</title><style>p > b {{ color: red }}</style><body class='single single-post'><div id='page'>
<div id='masthead' class='site-header'><p class='site-title'><a href='/'>Notes from the hill</a></p><div id='site-navigation' class='menu'><ul><li><a href='/'>Home</a></li><li><a href='/about'>About</a></li></ul></div></div>
<div id='content' class='site-content'><div id='primary'><div class='hentry'><h1 class='entry-title'>High water</h1><div class='entry-content'>
<p>{LONG[0]}<p>{LONG[1]}<h2>What the register says</h2><p><b>Note:</b> <i>see</i> {LONG[2]}<ul><li>three houses in 1784<li>one barn in 1901</ul><blockquote><p>{SHORT}</blockquote><p>{LONG[3]}</div>
<div class='sharedaddy share-buttons'><ul><li><a href=f>Share on F</a></li><li><a href=g>Share on G</a></li></ul></div></div>
<div id='comments' class='comments-area'><h2>One reply</h2><ol class='comment-list'><li class='comment'><p>Lovely post, thank you for writing this down before it is forgotten.</p></li></ol><form class='comment-form'><p><label>Name <input></label></p><p><button>Post Comment</button></p></form></div>
</div><div id='secondary' class='widget-area sidebar'><div class='widget'><h2>Recent posts</h2><ul><li><a href=a>Low water</a></li><li><a href=b>No water</a></li></ul></div></div></div>
<div id='colophon' class='site-footer'>Proudly made by hand</div></div></body></html>"""
BLOG_TEXT = "\n".join(["High water", *LONG[:2], "What the register says", "Note: see " + LONG[2], "three houses in 1784", "one barn in 1901", SHORT, LONG[3]])

PLAIN = f"""<HTML><BODY BGCOLOR=white><DIV CLASS=navbar><A HREF=index.html>Home</A> | <A HREF=links.html>Links</A> | <A HREF=mail.html>Mail</A></DIV>
<DIV ID=content><H1>The flood of this year</H1><P title=Miller's>{LONG[0]}<P>{LONG[1]}<P>{LONG[2]}<P>Prices: 5 &lt; 6 &amp; 7&nbsp;&gt; 6.<P>{LONG[3]}</DIV>
<DIV CLASS=footer>Last changed on a Monday</DIV></BODY></HTML>"""
PLAIN_TEXT = "\n".join(["The flood of this year", *LONG[:3], "Prices: 5 < 6 & 7 > 6.", LONG[3]])

BROKEN = f"""<html><head><title>t<title></title><body><nav><ul><li><a href=/>Home</a><li><a href=/b>Other pages</a></ul></nav>
<article><h1>Closed until May</h1><p>{LONG[0]} <button>Share<p>{LONG[1]}<p>{LONG[2]}<label>Beware</label> of the current.<p>{LONG[3]}</article>
<div class="related"><h3>Related</h3><ul><li><a href=x>Mills</a><li><a href=y>Bridges</a></ul></div><footer><p>About us</p></footer>"""
BROKEN_TEXT = "\n".join(["Closed until May", LONG[0], LONG[1], LONG[2] + "Beware of the current.", LONG[3]])

DOCS = f"""<html><body><div class="layout"><nav class="toc"><ul><li><a href=#a>Install</a><li><a href=#b>Use</a><li><a href=#c>Options</a></ul></nav>
<main role="main"><section id="a"><h2>Install</h2><p>{LONG[0]}</p><pre>make
make install</pre></section><section id="b"><h2>Use</h2><p>{LONG[1]}</p><table><tr><th>Option</th><th>Meaning</th></tr><tr><td>-q</td><td>say nothing</td></tr></table><p>{LONG[2]}</p></section></main></div>
<footer><a href=l>Licence</a> <a href=s>Source</a></footer></body></html>"""
DOCS_TEXT = "\n".join(["Install", LONG[0], "make make install", "Use", LONG[1], "Option", "Meaning", "-q", "say nothing", LONG[2]])

PAGES = {"news": (NEWS, NEWS_TEXT), "blog": (BLOG, BLOG_TEXT), "plain": (PLAIN, PLAIN_TEXT), "broken": (BROKEN, BROKEN_TEXT), "docs": (DOCS, DOCS_TEXT)}
