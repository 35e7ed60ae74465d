"""Values that queries on search schemes are held against, kept apart from the code under test."""

# Scheme, errors, and of each search the order of the parts, lower bounds and upper bounds.
SEARCHES = """
01star0 1 012-000-011 120-000-001
01star0 2 0123-0000-0122 1230-0000-0122 2310-0000-0022
01star0 3 01234-00000-01333 12340-00000-01333 23410-00000-01333 34210-00000-00333
01star0 4 012345-000000-014444 123450-000000-014444 234510-000000-014444 345210-000000-014444 453210-000000-004444
01star0 5 0123456-0000000-0155555 1234560-0000000-0155555 2345610-0000000-0155555 3456210-0000000-0155555 4563210-0000000-0155555 5643210-0000000-0055555
01star0_adapted 1 012-000-011 120-000-001
01star0_adapted 2 0123-0000-0122 1230-0000-0122 2310-0000-0022
01star0_adapted 3 01234-00000-01333 12340-00000-01333 23410-00000-01333 34210-00000-00333
01star0_adapted 4 012345-000004-012444 123450-000033-012334 234510-000222-012244 345210-001111-011444 453210-000000-003444
01star0_adapted 5 0123456-0000004-0123555 1234560-0000045-0124445 2345610-0000333-0123355 3456210-0002222-0122555 4563210-0011111-0115555 5643210-0000000-0035555
kianfar 1 01-00-01 10-00-01
kianfar 2 012-002-012 210-000-022 120-011-012
kianfar 3 0123-0003-0233 1230-0000-1233 2310-0022-0033
kianfar 4 01234-00004-03344 12340-00000-22334 43210-00033-00444
kuch_k+1 1 01-00-01 10-00-01
kuch_k+1 2 012-000-022 210-000-012 102-001-012
kuch_k+1 3 0123-0000-0133 1023-0011-0133 2310-0000-0133 3210-0011-0133
kuch_k+1 4 01234-00000-02244 43210-00000-01344 10234-00133-01344 01234-00133-01344 32410-00011-01244 21034-00013-01244 10234-00124-01244 01234-00034-00444
kuch_k+1_adapted 1 01-01-01 10-00-01
kuch_k+1_adapted 2 012-012-022 210-000-012 102-001-012
kuch_k+1_adapted 3 0123-0002-0133 1023-0113-0133 2310-0000-0133 3210-0111-0133
kuch_k+1_adapted 4 01234-00002-02244 43210-00000-01344 10234-01334-01334 01234-00334-01334 32410-00111-01244 21034-00113-01244 10234-01224-01244 01234-00344-00444
kuch_k+2 1 012-000-011 120-000-001
kuch_k+2 2 0123-0000-0112 3210-0000-0122 1230-0001-0012 0123-0002-0022
kuch_k+2 3 01234-00000-01233 12340-00000-01223 23410-00001-01133 34210-00012-00333
kuch_k+2 4 012345-000000-012344 123450-000000-012344 543210-000001-012244 345210-000012-011344 234510-000023-011244 453210-000133-003344 012345-000333-003344 012345-000044-002444 231045-000124-002244 453210-000044-001444
kuch_k+2_adapted 1 012-001-011 120-000-001
kuch_k+2_adapted 2 0123-0000-0112 3210-0012-0122 1230-0001-0012 0123-0022-0022
kuch_k+2_adapted 3 01234-00003-01233 12340-00000-01223 23410-00011-01133 34210-00122-00333
kuch_k+2_adapted 4 012345-001113-012344 123450-000000-012344 543210-000011-012244 345210-001122-011344 234510-011234-011244 453210-000334-003344 012345-000333-003344 012345-000044-002444 231045-001224-002244 453210-000444-001444
manbest 4 012345-000004-033344 123450-000000-022334 213450-011111-022334 321450-012222-012334 543210-000033-004444
pigeon 1 01-00-01 10-00-01
pigeon 2 012-000-022 120-000-022 210-000-022
pigeon 3 0123-0000-0333 1023-0000-0333 2310-0000-0333 3210-0000-0333
pigeon 4 01234-00000-04444 12340-00000-04444 23410-00000-04444 34210-00000-04444 43210-00000-04444
pigeon 5 012345-000000-055555 123450-000000-055555 234510-000000-055555 345210-000000-055555 453210-000000-055555 543210-000000-055555
pigeon_adapted 1 01-00-01 10-00-01
pigeon_adapted 2 012-000-022 120-000-022 210-000-022
pigeon_adapted 3 0123-0000-0333 1023-0000-0333 2310-0000-0333 3210-0000-0333
pigeon_adapted 4 01234-00002-01344 12340-00011-01334 23410-00000-01244 34210-00123-01444 43210-01234-02344
pigeon_adapted 5 012345-000001-012555 234510-000112-013355 123450-000023-013445 453210-001234-014555 345210-000000-012555 543210-012345-023555
"""

# Made with known faults: name, errors, searches, and the kinds of faults that validation must find.
BAD = """
gap 1 021-000-011 connectivity
twice 1 00-00-01_10-00-01 order
falling 2 012-000-021_210-000-022_120-000-022 decreasing_bounds
crossed 1 01-02-01_10-00-01 bounds
uncovered 1 01-00-01 uncovered
uncovered2 2 012-000-022_210-000-012 uncovered
sound 1 01-00-01_10-00-01
"""


def values_sql(text: str = SEARCHES) -> str:
    """A common table expression scheme(scheme, k, search_no, ord, lo, hi)."""
    rows = []
    for line in text.split("\n"):
        if line:
            name, k, *searches = line.split(" ")
            rows += [f"('{name}', {k}, {i}, {', '.join(f'[{x}]'.replace(x, ', '.join(x)) for x in s.split('-'))})" for i, s in enumerate(searches)]
    return f"scheme(scheme, k, search_no, ord, lo, hi) AS (VALUES {', '.join(rows)})"


def bad_rows() -> list[tuple[str, int, list[str], str]]:
    """name, errors, searches (order-lower-upper) and the kinds of faults, joined by commas."""
    out = []
    for line in BAD.split("\n"):
        if line:
            name, k, searches, *kinds = line.split(" ")
            out.append((name, int(k), searches.split("_"), ",".join(sorted(kinds))))
    return out
