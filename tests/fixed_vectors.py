"""Fixed test vectors: encoded payloads, and sample names with what they parse to."""

# Payloads made with the public JavaScript encoder.
EMPTY = "N4IgNglgzgLiBcBtAugXyA"
MINIMAL = (
    "N4IgNglgzgLiBcBtUAzCYCmA7AhgWwwRBg1gDo8BrANxABoQALHKRonAIwGMATDFAIwAmAMwAWAKwA2AOwAOAJwAGTr37Dx0"
    "+ctV9BQ+iCgQAXoXgClSgL4Bda0A"
)
SINGLE = (
    "N4IgNglgzgLiBcBtUAzCYCmA7AhgWwwRACEIBzAOmIFcBjAayuqywE8KAmABi4A4KAjHy4AHKmGoAlHOwAeHAGwAWEABoQACxxQNRACZ7"
    "eHAKzGMtPbQDstHKZQAjLg4cpeAgMwcPhq1wUceg4CKAp6ArRqIFAQAF6E8AJKCrwKSQrGCgC+ALpZQA"
)
BARE = (
    "NobwRAZglgNgpgOwIYFs5gFxgMoAskBOcAJgHQCyA9gG5RykBMADAwCykoDW1YANGPgDOuTGACMDAMysArADYA7AA4AnEyQAjAMbE4ECd"
    "PnK1mnXoOzFSvmA0BPAC5xBmGU3cf3AXwC6QA"
)

NAMES = [
    # name, title, year, season, episode, type
    ("The.Matrix.1999.1080p.BluRay.x264-GROUP", "The Matrix", 1999, None, None, "unknown"),
    ("Inception 2010 720p BRRip", "Inception", 2010, None, None, "unknown"),
    ("The_Dark_Knight_2008_1080p_BluRay", "The Dark Knight", 2008, None, None, "unknown"),
    ("Interstellar.2014.2160p.WEB-DL.x265.mkv", "Interstellar", 2014, None, None, "unknown"),
    ("Big.Buck.Bunny.1080p.BluRay", "Big Buck Bunny", None, None, None, "unknown"),
    ("Game.of.Thrones.S01E01.720p.HDTV.x264-CTU", "Game of Thrones", None, 1, 1, "episode"),
    ("the.office.s02e05.hdtv.x264", "the office", None, 2, 5, "episode"),
    ("The Walking Dead S05E03 720p HDTV x264-ASAP[ettv]", "The Walking Dead", None, 5, 3, "episode"),
    ("Friends.1x01.The.One.Where.DVDRip", "Friends", None, 1, 1, "episode"),
    ("Seinfeld.4x15.720p.HDTV", "Seinfeld", None, 4, 15, "episode"),
    ("The.100.S03E15E16.720p.HDTV.x264", "The 100", None, 3, 15, "episode"),
    ("House Season 3 Episode 12 720p", "House", None, 3, 12, "episode"),
    ("One.Piece.S01E100.1080p.WEB-DL", "One Piece", None, 1, 100, "episode"),
    ("9-1-1.Lone.Star.S04E01.720p.WEB.H264-CAKES", "9-1-1 Lone Star", None, 4, 1, "episode"),
    ("Breaking.Bad.S05.1080p.BluRay.x264", "Breaking Bad", None, 5, None, "season"),
    ("The Office Season 3 720p BluRay", "The Office", None, 3, None, "season"),
    ("Game.of.Thrones.S01.COMPLETE.720p.BluRay", "Game of Thrones", None, 1, None, "season"),
    ("Shogun.2024.S01E10.A.Dream.2160p", "Shogun", 2024, 1, 10, "episode"),
    ("Schindler's.List.1993.1080p.BluRay.x264", "Schindler's List", 1993, None, None, "unknown"),
    ("Mr_Robot_S01E01_1080p.BluRay-GROUP", "Mr Robot", None, 1, 1, "episode"),
    # own edge cases
    ("Movie (1999) 1080p", "Movie (1999", None, None, None, "unknown"),
    ("Blade.Runner.2049.2017.1080p", "Blade Runner", 2049, None, None, "unknown"),
    ("Spider-Man", "Spider", None, None, None, "unknown"),
    ("Show.0x12.S02.720p", "Show 0x12", None, 2, None, "season"),
    ("Show.0x12.3x04", "Show 0x12 3x04", None, None, None, "unknown"),
    ("2012.2009.1080p", "2012", 2009, None, None, "unknown"),
    ("Season 2 S01E03 x", "Season 2", None, 1, 3, "episode"),
    ("A Season 2 then S01E03", "A Season 2 then", None, 1, 3, "episode"),
    ("Two S01E02", "Two", None, 1, 2, "episode"),
    ("Film 🎬 Title 2001 720p", "Film 🎬 Title", 2001, None, None, "unknown"),
    ("Line\nbreak.S02E03", "Line\nbreak", None, 2, 3, "episode"),
    ("\u0001Odd.S02E03", "\u0001Odd", None, 2, 3, "episode"),
    ("\u0001a\u00011\u00012\u0001b", "\u0001a\u00011\u00012\u0001b", None, None, None, "unknown"),
    # A non-ASCII digit matches but does not become a number.
    ("Name.١x12", "Name", None, None, 12, "episode"),
    ("film.srt", "film srt", None, None, None, "unknown"),
    ("", None, None, None, None, None),
    ("1080p.BluRay.x264", None, None, None, None, None),
    ("X", None, None, None, None, None),
    (None, None, None, None, None, None),
]
