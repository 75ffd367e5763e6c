"""Documents shared by the stage tests."""

from titleloom.plans.encode import compress

CHAIN_MARKER = "example.com/list#"


def chain_documents():
    json = (
        '[{"filename":"Show.S01E02.720p","hash":"h1","size":5},'
        '{"filename":"Film.2001.720p","hash":"h2","bytes":6},'
        '{"filename":"1080p","hash":"h3","bytes":7}]'
    )
    return [
        ("a.html", f'<iframe src="https://{CHAIN_MARKER}{compress(json)}">'),
        ("b.html", "<html></html>"),
        ("c.html", "never listed"),
    ]
