"""Pages written by hand after common templates, each with its main text: none comes from the module's own generator."""

BLOG = (
    """<!DOCTYPE html><html><head><title>On kettles</title></head><body class="home blog">
<div id="page" class="hfeed site"><header id="masthead"><p class="site-title"><a href="/">Tea notes</a></p><nav id="site-navigation" class="main-navigation"><ul class="menu"><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav></header>
<div id="content" class="site-content"><main id="main" class="site-main"><article id="post-12" class="post type-post"><h1 class="entry-title">On kettles</h1>
<div class="entry-content"><p>A kettle that pours slowly is worth more than one that boils fast, as anyone who makes tea for two will tell you.</p>
<p>Ours is ten years old, has a <em>dented</em> lid, and still holds its heat for half an hour.</p><ul><li>Rinse it every week.</li><li>Never leave water in it overnight.</li></ul>
<blockquote><p>A good kettle, my aunt said, is one you forget about.</p></blockquote></div></article></main>
<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/1">Cups</a></li><li><a href="/2">Spoons</a></li></ul></section></aside></div>
<footer id="colophon" class="site-footer"><div class="site-info">Powered by a hosting firm</div></footer></div></body></html>""",
    "On kettles\nA kettle that pours slowly is worth more than one that boils fast, as anyone who makes tea for two will tell you.\nOurs is ten years old, has a dented lid, and still holds its heat for half an hour.\nRinse it every week.\nNever leave water in it overnight.\nA good kettle, my aunt said, is one you forget about.",
)

NEWS = (
    """<html><head><title>Bridge closed</title><script>window.x='<div>';</script></head><body>
<div class="cookie-banner"><p>We use cookies to improve this site and to show you offers that may interest you.</p><button>Accept</button></div>
<header class="top"><a href="/"><img src="l.png"></a><nav><a href="/w">World</a> <a href="/s">Sport</a></nav></header>
<main><article class="story"><h1>Old bridge closed until spring</h1><p>The council closed the old bridge on Monday after divers found cracks below the waterline.</p>
<div class="advert"><a href="/buy">Cheap flights from here</a></div>
<p>Repairs will take until April, said the head of works, &quot;if the river lets us&quot;.</p><p>Buses go round by the mill.</p></article>
<section class="comments"><h3>2 comments</h3><div class="comment"><p>About time that somebody had a look at it, I said so years ago.</p></div><div class="comment"><p>What about the fish?</p></div></section></main>
<footer><p>Copyright, all rights reserved</p></footer></body></html>""",
    'Old bridge closed until spring\nThe council closed the old bridge on Monday after divers found cracks below the waterline.\nRepairs will take until April, said the head of works, "if the river lets us".\nBuses go round by the mill.',
)

MANUAL = (
    """<html><head><title>sort</title></head><body><div class="toc menu"><ul><li><a href="#a">Name</a></li><li><a href="#b">Options</a></li><li><a href="#c">Notes</a></li></ul></div>
<div class="content"><h1>sort</h1><p>Sort puts the lines of a file in order and writes them to its output, one after the other.</p><h2>Options</h2>
<table><tr><td>-r</td><td>reverse the order of the lines</td></tr><tr><td>-u</td><td>of equal lines write one</td></tr></table>
<pre>sort -r names.txt</pre><p>Lines are compared byte by byte unless a locale is set, so capitals come before small letters.</p></div>
<div class="footer">Manual of 2021</div></body></html>""",
    "sort\nSort puts the lines of a file in order and writes them to its output, one after the other.\nOptions\n-r\nreverse the order of the lines\n-u\nof equal lines write one\nsort -r names.txt\nLines are compared byte by byte unless a locale is set, so capitals come before small letters.",
)

PLAIN = (
    """<html><head><title>x</title></head><body><nav><ul><li><a href=/a>First</a></li><li><a href=/b>Second</a></li><li><a href=/c>Third</a></li></ul></nav>
<article><h1>Rain</h1><p>It rained all week, and the lower field stood under water from the gate to the willows.<p>On Sunday the sun came out.<br>Nobody trusted it.<p>By Monday, with x<math><mo>=</mo><mn>3</mn></math> pumps, we were dry.</article>
<aside class="related"><h3>More</h3><a href="/z">Snow</a></aside><form class="newsletter"><label>Mail</label><input><button>Send</button></form></body></html>""",
    "Rain\nIt rained all week, and the lower field stood under water from the gate to the willows.\nOn Sunday the sun came out.\nNobody trusted it.\nBy Monday, with x=3 pumps, we were dry.",
)

MISNAMED = (
    """<html><head><title>x</title></head><body><header><h2>Weekly paper</h2><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></header>
<div class="article-comments-off content"><h1>The long wall</h1><p>Nobody knows who built the wall above the village, nor when, nor what it was to keep out.</p><p>It runs for two miles, turns, and stops at a spring.</p></div>
<footer>Paper, 2020</footer></body></html>""",
    "The long wall\nNobody knows who built the wall above the village, nor when, nor what it was to keep out.\nIt runs for two miles, turns, and stops at a spring.",
)

UNCLOSED = (
    """<html><head><title>x</title></head><body><nav><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></nav>
<article><h1>Lamps</h1><p>The lamps along the quay were lit by hand until the year before the war, by one man with a ladder.</p><div><svg><path d="M0"></div>
<p>He knew each of them, he said, as others know their sheep.</p></article><footer>Quay society</footer></body></html>""",
    "Lamps\nThe lamps along the quay were lit by hand until the year before the war, by one man with a ladder.\nHe knew each of them, he said, as others know their sheep.",
)

ALL = {"blog": BLOG, "news": NEWS, "manual": MANUAL, "plain": PLAIN, "misnamed": MISNAMED, "unclosed": UNCLOSED}
