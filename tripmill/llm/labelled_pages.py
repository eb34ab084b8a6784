"""Pages labelled by hand, for the weights of ``html_extraction``: the main text lies between <!--main--> and <!--/main-->."""

LONG = (
    "The valley was settled late, since its river flooded twice a year and carried away whatever was built near the banks. Only when the upper dam was finished did farmers move down from the hills, "
    "and even then they kept their barns on the slopes. Old maps show the road making a wide turn around the marsh."
)
MORE = (
    "Most of the mills closed within ten years. A few were turned into workshops, and one of them still grinds flour on the first Sunday of every month, for visitors more than for bread. "
    "Its wheel was replaced in spring, after three winters in which nobody dared to start it."
)
LAST = "Nobody expects the railway to come back, but the bridge will be repaired, and a path for walkers and bicycles is to follow the old line as far as the lake."
SHORT = "It took four years."

PAGES = (
    # a news page of plain divisions, without a single element that says what it is
    f"""<html><head><title>Valley | News</title></head><body><div><div><a href="/">Home</a> <a href="/w">World</a> <a href="/s">Sport</a> <a href="/m">Money</a></div></div>
<div><div><!--main--><h1>Water in the valley</h1><p>{LONG}</p><p>{MORE}</p><p>{SHORT}</p><p>{LAST}</p><!--/main--></div>
<div><h3>More stories</h3><ul><li><a href="/1">Storm closes the harbour</a></li><li><a href="/2">New school opens</a></li><li><a href="/3">Prices rise again</a></li></ul></div></div>
<div><span>Contact</span> <span>Terms of use</span> <span>Valley Media</span></div></body></html>""",
    # a page that marks its article
    f"""<!DOCTYPE html><html><body><div><ul><li><a href="/a">Start</a></li><li><a href="/b">About</a></li></ul></div><p>Welcome to our pages, which are renewed every week.</p>
<article><!--main--><h1>Mills</h1><p>{MORE}</p><h2>What is left</h2><p>{SHORT}</p><ul><li>one wheel</li><li>two stones</li></ul><blockquote>{LAST}</blockquote><p>{LONG}</p><!--/main--></article>
<div><p>Printed on recycled paper. All prices without tax.</p></div></body></html>""",
    # a main element around sections
    f"""<html><body><div><a href="/">Docs</a><a href="/api">API</a></div><main><!--main--><h1>Installing the pump</h1><section><h2>Before you begin</h2><p>{LAST}</p><ol><li>Close the valve.</li><li>Drain the pipe and wait until no
water is left in it.</li></ol></section><section><h2>Steps</h2><p>{MORE}</p><pre>open valve 3
wait 20</pre><p>{SHORT}</p></section><!--/main--></main><div><a href="/prev">Previous</a><a href="/next">Next</a></div><div>Last built in May</div></body></html>""",
    # an old page in tables
    f"""<html><body><table><tr><td><a href="a.htm">Index</a><br><a href="b.htm">Photos</a><br><a href="c.htm">Guestbook</a><br><a href="d.htm">Links</a></td><td><!--main--><h2>The old railway</h2>{LONG}<br><br>{MORE}
<br><br>{LAST}<!--/main--></td></tr><tr><td><font size="1">Best seen with 800 x 600</font></td><td><a href="mailto:x">Write to us</a></td></tr></table></body></html>""",
    # paragraphs never closed, text between tags
    f"""<body><a href="/">Home</a> | <a href="/l">Letters</a> | <a href="/s">Search</a><hr><!--main--><h1>A letter</h1><p>{LAST}<p>{SHORT}<p>{LONG}<p>{MORE}<!--/main--><hr><a href="/1">one</a> <a href="/2">two</a></body>""",
    # bare text with line breaks
    f"""<html><body><!--main-->{MORE}<br><br>{SHORT}<br>{LAST}<!--/main--></body></html>""",
    # content in divisions named so, tags and dates around it
    f"""<html><body><div id="wrap"><div><a href="/"><img src="l.png"></a><span>Notes of a walker</span></div><div class="post-body entry-content"><!--main--><h2>To the lake</h2><div>{LONG}</div><div>{MORE} <a href="/m">{SHORT}</a> {LAST}</div>
<div>{SHORT}</div><!--/main--></div><div><div>Posted in <a href="/w">walks</a>, <a href="/l">lakes</a></div><div><a href="/o">Older</a> <a href="/n">Newer</a></div></div>
<div><h4>Archive</h4><ul><li><a href="/05">May</a> (4)</li><li><a href="/06">June</a> (2)</li><li><a href="/07">July</a> (9)</li></ul></div></div></body></html>""",
    # an encyclopedia page with a table and lists
    f"""<html><body><div id="content"><!--main--><h1>River mill</h1><p>{LONG}</p><table><tr><th>Year</th><th>Mills</th></tr><tr><td>1850</td><td>forty</td></tr><tr><td>1900</td><td>nine</td></tr></table><h2>Kinds</h2>
<ul><li>Mills with an undershot wheel, which need a steady stream and little fall</li><li>Mills with an overshot wheel</li></ul><p>{MORE} See also <a href="/wheel">water wheel</a>.</p><dl><dt>Race</dt><dd>The channel that leads to the wheel.</dd></dl>
<figure><img src="m.jpg"><figcaption>A mill in winter</figcaption></figure><p>{LAST}</p><!--/main--></div><div><ul><li><a href="/main">Main page</a></li><li><a href="/rand">Random page</a></li><li><a href="/help">Help</a></li></ul><ul>
<li><a href="/de">Deutsch</a></li><li><a href="/fr">Fran&ccedil;ais</a></li><li><a href="/es">Espa&ntilde;ol</a></li></ul></div><div><p>Text may be copied.</p></div></body></html>""",
    # a shop: much around, little text
    f"""<html><body><div><a href="/c">Cart (0)</a><a href="/i">Sign in</a></div><div><a href="/t">Tools</a> &gt; <a href="/p">Pumps</a></div><div><!--main--><h1>Hand pump</h1><p>{SHORT} {LAST}</p><p>{LONG}</p><!--/main--></div><div><div><a href="/p1">Pump, small</a>
<span>19.00</span></div><div><a href="/p2">Pump, large</a> <span>49.00</span></div><div><a href="/h">Hose</a> <span>9.00</span></div></div><div>Shipping <a href="/sh">rates</a> Returns <a href="/r">policy</a></div></body></html>""",
    # a page whose article element is one of several, teasers after it
    f"""<html><body><p><a href="/">The Walker</a></p><article><!--main--><h1>Bridges</h1><p>{LONG}</p><p>{LAST}</p><p>{MORE}</p><!--/main--></article><div><h2>Read on</h2><div><h3><a href="/x">Ferries</a></h3><p>From our own reporter.</p></div>
<div><h3><a href="/y">Fords</a></h3><p>Three of them are still in use.</p></div></div></body></html>""",
    # nothing but links
    """<html><body><h3>Places by name</h3><ul><li><a href="/a">Aachen</a></li><li><a href="/b">Bergen</a></li><li><a href="/c">Calais</a></li><li><a href="/d">Delft</a></li></ul><p><a href="/all">All places</a></p></body></html>""",
    # a forum question, short lines around it
    f"""<html><body><div><a href="/q">Questions</a><a href="/u">Users</a></div><div class="question-text"><!--main--><h1>How do I stop a leak?</h1><p>{SHORT} {MORE}</p><p>{LAST}</p><!--/main--></div><div><span>asked 3 days ago</span><span>viewed 71 times</span><a href="/u/4">miller</a></div></body></html>""",
    # everything in one form, one-word headings
    f"""<html><body><form action="/"><div><a href="/">Home</a> <a href="/m">Map</a></div><div><!--main--><h1>Ferries</h1><p>{LAST}</p><h2>Timetable</h2><p>{MORE}</p><h2>Prices</h2><p>{SHORT}</p><p>{LONG}</p><!--/main--></div><div>Page 3 of 9</div></form></body></html>""",
)
