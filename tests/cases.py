"""Golden cases as data. {R} stands for the reserved root namespace.

A scenario is a list of steps: ("add", id, tags), ("ask", query, ids) or ("postfix", query,
ids). CORE is what most scenarios start from.
"""

GOOD_TAGS = [
    ("urgent", None, "urgent", None),
    ("range=5", None, "range", "5"),
    ("geo:lat=57.64", "geo", "lat", "57.64"),
    ("geo:lat", "geo", "lat", None),
    ("temp=-5", None, "temp", "-5"),
    ("version=2.0.0-rc1", None, "version", "2.0.0-rc1"),
    ("and", None, "and", None),
    ("due=2026-08-01", None, "due", "2026-08-01"),
    ("version=1.0.0+build.5", None, "version", "1.0.0+build.5"),
    ("version=-1.0.0+b", None, "version", "-1.0.0+b"),
    ("a+b:c+d=e+f", "a+b", "c+d", "e+f"),
    ("k=+1", None, "k", "+1"),
    ("k=+build", None, "k", "+build"),
    ("-key", None, "-key", None),
    ("+key", None, "+key", None),
    ("k=-", None, "k", "-"),
    ('due="2026-08-01T10:00:00"', None, "due", "2026-08-01T10:00:00"),
    ('note="hello world"', None, "note", "hello world"),
    ('"a:b"=c', None, "a:b", "c"),
    ('x="3.5"', None, "x", "3.5"),
    ('x="say ""hi"""', None, "x", 'say "hi"'),
    ('x=""', None, "x", ""),
    ('"":k', "", "k", None),
    ('k="+"', None, "k", "+"),
]

BAD_TAGS = [
    "=5", ":key", "ns:", "key=", "*", "ns:*=5", "key=+", "key=1.0*0", ".key", "a b", "a=b=c", "a:b:c", "key=va~lue", "",
    'x="abc', "+", "+:k", "k\n", 'x="a"b', 'x=a"b"', "k=é", "k=a:b",
]

COMPILED = [
    ("urgent", "urgent"),
    ("urgent and range>4", "urgent/range>4/and"),
    ("a or b and c", "a/b/c/and/or"),
    ("(a or b) and c", "a/b/or/c/and"),
    ("not a and b", "a/not/b/and"),
    ("not (a and b)", "a/b/and/not"),
    ("not not a", "a/not/not"),
    ("a and b and c", "a/b/and/c/and"),
    ("*:lang=en and not status=done", "*:lang=en/status=done/not/and"),
    ("*", "*"),
    ("and=*", "and=*"),
    ('note="hello world"', 'note="hello world"'),
    ('"a:b"=c and x', '"a:b"=c/x/and'),
    ("urgent AND range>4", "urgent/range>4/and"),
    ("urgent And not status=done", "urgent/status=done/not/and"),
    ("a OR b And c", "a/b/c/and/or"),
    ("a b", "a/b/and"),
    ("a b c", "a/b/and/c/and"),
    ("a (b or c)", "a/b/c/or/and"),
    ("not a b", "a/not/b/and"),
    ("version=1.0.0+build.5", "version=1.0.0+build.5"),
    ("+:+=+", "+:+=+"),
    ("v=1.0.0+b and v=+", "v=1.0.0+b/v=+/and"),
    ("(v=1.0.0+b or v=+) and not v=*", "v=1.0.0+b/v=+/or/v=*/not/and"),
    ("v=+1", "v=+1"),
    ("v=+build", "v=+build"),
    ("-key or +key", "-key/+key/or"),
    ("a or b or c and d or e", "a/b/or/c/d/and/or/e/or"),
]

NOT_COMPILED = ["a and", "and a", "(a", "a )", "a & b", "not", "a=* or", 'note="unterminated', "v=1.0*0", "", "  ", "()", "a or and b", "a (", "a!b", "a>>5"]
NOT_POSTFIX = ["", "a / b", "a//b", "and", "a/and", "a/b/and/or", "not", "a/", '"x', "/a"]

CORE = [
    ("add", "a", "urgent lang=en lang=fr range=5 geo:lat=57.64 status=done"),
    ("add", "b", "range=tbd lang=en prio:urgent due=2026-08-01"),
    ("add", "c", "urgent=false score=-3 note"),
]

SCENARIOS = {
    "core": CORE
    + [
        ("ask", "urgent", "a c"),
        ("ask", "*:urgent", "a b c"),
        ("ask", "+:urgent", "b"),
        ("ask", "prio:urgent", "b"),
        ("ask", "lang=en", "a b"),
        ("ask", "lang=fr", "a"),
        ("ask", "lang!=en", "a"),
        ("ask", "range>4", "a"),
        ("ask", 'range>"4"', "a"),
        ("ask", "range>5", ""),
        ("ask", "score<0", "c"),
        ("ask", "urgent=+", "c"),
        ("ask", "urgent=*", "a c"),
        ("ask", "geo:*", "a"),
        ("ask", "lat>57", ""),
        ("ask", "*:lat>57", "a"),
        ("ask", "due~2026-..-..", "b"),
        ("ask", "due~2026", ""),
        ("ask", "not urgent", "b"),
        ("ask", "urgent and not status=done", "c"),
        ("ask", "lang=en or score<0", "a b c"),
        ("ask", "urgent AND NOT status=done", "c"),
        ("ask", "Not urgent", "b"),
        ("ask", "urgent range=5 status=done", "a"),
        ("ask", "+", "a b c"),
        ("ask", "+:+", "a b"),
        ("ask", "+:+=+", "a"),
        ("ask", "range=+", "a b"),
        ("postfix", "urgent/status=done/not/and", "c"),
        ("postfix", "urgent/range=5", "a"),
        ("postfix", "urgent/range=5/status=done", "a"),
        ("postfix", "lang=fr/score<0/or/range=5", "a"),
        ("postfix", "urgent/status=done/NOT/AND", "c"),
        ("postfix", "lang=en/score<0/Or", "a b c"),
    ],
    "bare star": CORE + [("add", "e", "prio:high"), ("ask", "*", "a b c"), ("ask", "*:*", "a b c e")],
    "reserved words": CORE + [("add", "d", "not=x"), ("ask", "not=*", "d"), ("ask", "not not=x", "a b c"), ("add", "r", "and"), ("postfix", '"and"', "r"), ("ask", '"and"', "r")],
    "quoting": CORE
    + [
        ("add", "f", 'due="2026-08-01T10:00:00"'),
        ("ask", 'due="2026-08-01T10:00:00"', "f"),
        ("add", "p", 'x=""'),
        ("add", "q", "x"),
        ("ask", "x=+", "p"),
        ("ask", 'x=""', "p"),
        ("add", "g", 'path="/etc/passwd"'),
        ("ask", 'path="/etc/passwd"', "g"),
        ("postfix", 'path="/etc/passwd"', "g"),
        ("add", "h", 'note="hello world" urgent'),
        ("ask", 'note="hello world"', "h"),
        ("ask", "urgent", "a c h"),
    ],
    "plus": [
        ("add", "v1", "version=1.0.0+build.5"),
        ("add", "v2", 'version="1.0.0+build.5"'),
        ("add", "v3", "version=1.0.0"),
        ("ask", "version=1.0.0+build.5", "v1 v2"),
        ("ask", 'version="1.0.0+build.5"', "v1 v2"),
        ("ask", "version!=1.0.0+build.5", "v3"),
        ("ask", "version~1.0.0+build..", "v1 v2"),
        ("ask", "version=+", "v1 v2 v3"),
    ],
    "signs": [
        ("add", "p", "k=+1"),
        ("add", "q", "k=1"),
        ("add", "qp", 'k="+1"'),
        ("add", "r", "z=-0"),
        ("add", "s", "z=0"),
        ("ask", "k>=1", "p q qp"),
        ("ask", "k<=1", "p q qp"),
        ("ask", "k>1", ""),
        ("ask", "k=1", "q"),
        ("ask", "k=+1", "p qp"),
        ("ask", "z=0", "s"),
        ("ask", "z>=0", "r s"),
        ("ask", "z<=0", "r s"),
        ("add", "t", "-ns:+key=-1"),
        ("ask", "-ns:+key=-1", "t"),
        ("ask", "+:+key=+", "t"),
    ],
    "hidden by default": [("add", "a", "{R}.arity:kind=binary"), ("add", "b", "urgent"), ("ask", "*:*", "b"), ("ask", "urgent", "b"), ("ask", "{R}.arity:*", "a")],
    "near misses": [("add", "a", "{R}.arity:kind=binary"), ("add", "x1", "{R}x:w=1"), ("add", "x2", "{R}-foo:w=1"), ("add", "x3", "{R}Z:w=1"), ("ask", "*:*", "x1 x2 x3")],
    "hidden namespace": [("add", "a", '{R}.hide:"triage:*"=true'), ("add", "b", "triage:impact=high"), ("add", "c", "urgent"), ("ask", "*:*", "c"), ("ask", "triage:*", "b")],
    "default off": [("add", "a", '{R}.hide:"{R}:*"=false'), ("add", "b", "{R}.arity:kind=binary"), ("add", "c", "urgent"), ("ask", "*:*", "a b c")],
    "wild reveals nothing": [("add", "w", "{R}.arity:kind=binary"), ("ask", "*:kind=binary", ""), ("ask", "+:kind=binary", ""), ("ask", "{R}.arity:kind=binary", "w")],
    "no lending": [("add", "w", "{R}.arity:x=1 urgent"), ("ask", "*:x=1", ""), ("ask", "{R}:foo or *:x=1", "")],
    "complement": [("add", "z", "{R}.arity:kind=binary"), ("add", "b", "urgent"), ("add", "c", "score=1"), ("ask", "not urgent", "c")],
    "reveals and matches": [("add", "z", "{R}.arity:foo"), ("add", "b", "urgent"), ("ask", "{R}.arity:foo and not urgent", "z")],
    "key hide": [
        ("add", "cfg", '{R}.hide:"triage:cwe"=true'),
        ("add", "a", "triage:cwe=79"),
        ("add", "b", "triage:type=bug"),
        ("ask", "*:*", "b"),
        ("ask", "triage:cwe", "a"),
        ("ask", "triage:type", "b"),
        ("ask", "not triage:type", ""),
        ("ask", "triage:*", "a b"),
    ],
    "key in all namespaces": [("add", "cfg", '{R}.hide:"*:secret"=true'), ("add", "a", "secret=shh"), ("add", "b", "ns:secret=shh"), ("add", "c", "urgent"), ("ask", "*:*", "c"), ("ask", "secret", "a"), ("ask", "ns:secret", "b")],
    "null namespace hide": [("add", "cfg", "{R}.hide:secret=true"), ("add", "z", "secret=shh"), ("add", "b", "urgent"), ("ask", "*:*", "b"), ("ask", "*:secret", ""), ("ask", "secret", "z"), ("ask", "secret or urgent", "b z"), ("ask", "*", "b z")],
    "doubly hidden": [("add", "cfg1", '{R}.hide:"triage:*"=true'), ("add", "cfg2", '{R}.hide:"triage:cwe"=true'), ("add", "z", "triage:cwe=79"), ("ask", "triage:type", ""), ("ask", "not triage:type", ""), ("ask", "triage:cwe", "z")],
    "scalar": [
        ("add", "cfg", "{R}.arity:k=scalar"),
        ("add", "a", "k=1"),
        ("add", "a", "k=2"),
        ("add", "b", "k=9"),
        ("add", "b", "k=9"),
        ("ask", "k=1", ""),
        ("ask", "k=2", "a"),
        ("ask", "k=9", "b"),
        ("add", "a", "k"),
        ("ask", "k=+", "b"),
        ("ask", "k", "a b"),
    ],
    "set by default": [("add", "a", "k=1"), ("add", "a", "k=2"), ("ask", "k=1", "a"), ("ask", "k=2", "a")],
    "scalar target": [
        ("add", "cfg", '{R}.arity:"triage:impact"=scalar'),
        ("add", "a", "triage:impact=low"),
        ("add", "a", "triage:impact=high"),
        ("add", "a", "triage:type=bug"),
        ("add", "a", "triage:type=feature"),
        ("ask", "triage:impact=low", ""),
        ("ask", "triage:impact=high", "a"),
        ("ask", "triage:type=bug", "a"),
        ("ask", "triage:type=feature", "a"),
    ],
    "late and in-batch": [
        ("add", "a", "k=1"),
        ("add", "a", "{R}.arity:k=scalar k=2 k=3"),
        ("ask", "k=1 k=2 k=3", "a"),
        ("add", "a", "k=4 k=5"),
        ("ask", "k=5", "a"),
        ("ask", "k=1 or k=2 or k=3 or k=4", ""),
    ],
    "semver": [
        ("add", "cfg", "{R}.type:v=semver"),
        *[("add", f"s{i}", f"v={v}") for i, v in enumerate("1.0.0-alpha 1.0.0-alpha.1 1.0.0-alpha.beta 1.0.0-beta 1.0.0-beta.2 1.0.0-beta.11 1.0.0-rc.1 1.0.0".split(), 1)],
        ("ask", "v<1.0.0-alpha.1", "s1"),
        ("ask", "v<1.0.0-alpha.beta", "s1 s2"),
        ("ask", "v<1.0.0-beta.2", "s1 s2 s3 s4"),
        ("ask", "v<1.0.0-beta.11", "s1 s2 s3 s4 s5"),
        ("ask", "v<1.0.0", "s1 s2 s3 s4 s5 s6 s7"),
        ("add", "n", "v=1.0.0+build.5"),
        ("add", "x", "v=not-a-version"),
        ("ask", "v>=1.0.0+a", "n s8"),
        ("ask", "v<=1.0.0 and not v<1.0.0", "n s8"),
        ("ask", "v>1.0.0-rc.1+build.5", "n s8"),
    ],
    "unheard type": [("add", "cfg", "{R}.type:n=unheard"), ("add", "a", "n=3"), ("add", "b", "n=10"), ("add", "c", "n=1.2.3-beta"), ("ask", "n>4", "b"), ("ask", "n>1.0.0", "")],
    "two types": [("add", "cfg", "{R}.type:v=semver"), ("add", "cfg2", "{R}.type:v=date"), ("add", "a", "v=1.0.0-beta"), ("add", "b", "v=5"), ("ask", "v>1.0.0-alpha", ""), ("ask", "v>4", "b")],
    "type before numbers": [
        ("add", "cfg", "{R}.type:ver=version"),
        ("add", "a", "ver=1.9"),
        ("add", "b", "ver=1.10"),
        ("ask", "ver>1.9", "b"),
        ("ask", "ver<1.9", ""),
        ("add", "c", "plain=1.9"),
        ("add", "d", "plain=1.10"),
        ("ask", "plain>1.9", ""),
        ("ask", "plain<1.9", "d"),
        ("ask", "*:*>1.9", "b"),
    ],
}
