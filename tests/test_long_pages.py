from postmill.sources import pages as pg


def test_long_page_keeps_description_and_sections(spark):
    wanted = [f"Requirement number {k} with some words around it" for k in range(60)]
    asked = [f"Candidate line {k} with some words around it" for k in range(20)]
    body = "Intro words here. Requirements: " + ". ".join(wanted) + ". Candidate profile: " + ". ".join(asked) + ". " + "Further words. " * 400
    html = f'<html><body><h1>Chef Wanted</h1><div class="job-description">{body}</div></body></html>'
    pages = spark.createDataFrame([("https://x.co/ilan/chef-wanted-12345", html)], "url string, html string")
    (row,) = pg.pages_to_listings(pages).collect()
    assert row["description"] == body.strip() and len(body) > 9000
    assert list(row["requirements"]) == ["Requirements: " + wanted[0], *wanted[1:]]
    assert list(row["candidate_criteria"])[:20] == ["Candidate profile: " + asked[0], *asked[1:]]
