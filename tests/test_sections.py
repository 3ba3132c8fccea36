"""Sections and entries of own résumés and job descriptions, shape by shape."""

import pytest

from harrow.operators import sections as op

RESUMES = {
    1: "ANNA LEE\nanna@mail.example\n\nSKILLS\nPython, SQL and a good deal of Spark besides\n\nEXPERIENCE\nData Analyst - Bar Works\nMar 2021 - Present\n• Built boards\n• Kept them up\n\nEDUCATION\nB.Sc Computer Science - Lake University",
    2: "Ben\n=== WORK EXPERIENCE ===\nSilver Bus | Thane\nCloud Intern\n• Built cloud things\n\nEducation\nBCA - Hill College\n2015 - 2018",
    3: "Carl\nProfessional Experience:\n07/2025 – 10/2025 | Remote\nDevOps Intern\n• Built pipelines\n04/2024 - 06/2025\nTest Engineer\nGrey Ltd\n● Wrote tests\nReferences\nAsk Grey Ltd\nSkills\nx",
    4: "INTERNSHIP\nSoftware Intern - Valley - (Jun 2023 - Aug 2023)\n● Automated things\nJunior Developer - Mount, Pune\nJan 2022 - May 2023\nLead Developer — River\nJun 2020 - Dec 2021\n",
    5: "Short lines\nof no known name\nJust Prose\nthat goes on",
    6: "",
    7: None,
    8: "Education\nBachelor of Arts\nSea University\n2010 - 2013\nCGPA: 8.1\nHSC\nTown School\n2008\nSkills: Java, Go\nEducation\nBachelor of Arts Sea University 2010 - 2013 CGPA 8.1 HSC Town School 2008",
    9: "Experience\nAcme Labs\nSenior Engineer\n2019-2021\nAcme Labs\nEngineer\n2017-2019\n✓ Skills\nI have skills.\nKey Skills & Abilities",
}


@pytest.fixture(scope="module")
def rows(spark):
    texts = spark.createDataFrame(list(RESUMES.items()), "id long, text string")
    return op.sectioned(op.text_lines(texts, "text"), op.heading_table(spark, op.RESUME_HEADINGS), "id").cache()


def test_sections(rows):
    got = {}
    for r in op.sections(rows, "id").orderBy("id", "section").collect():
        got.setdefault(r.id, []).append((r.label, r.source, r.lines))
    assert got[1] == [("Preamble", "heuristic", 2), ("Skills", "heuristic", 1), ("Experience", "heuristic", 4), ("Education", "uncertain", 1)]
    assert [x[0] for x in got[2]] == ["Preamble", "Experience", "Education"]
    assert [x[0] for x in got[3]] == ["Preamble", "Experience", "Skills"]  # references within jobs open no section
    assert got[5] == [("Preamble", "heuristic", 4)] and 6 not in got and 7 not in got
    assert got[8] == [("Education", "heuristic", 7), ("Skills", "uncertain", 1), ("Unclassified", "uncertain", 1)]
    assert [x[0] for x in got[9]] == ["Experience"]


def test_experience(rows):
    got = {}
    for r in op.experience(rows, "id").orderBy("id", "section", "entry").collect():
        got.setdefault(r.id, []).append(tuple(r)[3:])
    assert got[1] == [("Data Analyst", "Bar Works", "", "2021-03", "present", 2)]
    assert got[2] == [("Cloud Intern", "Silver Bus", "Thane", "", "", 1)]
    assert got[3][:2] == [("DevOps Intern", "", "Remote", "2025-07", "2025-10", 1), ("Test Engineer", "Grey Ltd", "", "2024-04", "2025-06", 1)]
    assert got[4] == [("Software Intern", "Valley", "", "2023-06", "2023-08", 1), ("Junior Developer", "Mount", "Pune", "2022-01", "2023-05", 0), ("Lead Developer", "River", "", "2020-06", "2021-12", 0)]
    assert [x[:2] + x[3:5] for x in got[9][:2]] == [("Senior Engineer", "Acme Labs", "2019", "2021"), ("Engineer", "Acme Labs", "2017", "2019")]
    assert 5 not in got and 7 not in got


def test_education(rows):
    got = {}
    for r in op.education(rows, "id").orderBy("id", "section", "entry").collect():
        got.setdefault(r.id, []).append(tuple(r)[3:])
    assert got[1] == [("B.Sc Computer Science", "Lake University", "", "", "")]
    assert got[2] == [("BCA", "Hill College", "2015", "2018", "")]
    assert got[8][:2] == [("Bachelor of Arts", "Sea University", "2010", "2013", "8.1"), ("HSC", "Town School", "2008", "", "")]


def test_job_descriptions(spark):
    jobs = {
        1: "Cloud Engineer\n\nLocation: Remote\n\nAbout the role\nWe look for one who runs things.\n\nKey Responsibilities\n• Run clusters for many\n  customers of ours\n• Answer calls\n\nRequired Skills:\n• AWS, EC2\n• Terraform.\nNice-to-have\n• Istio",
        2: "Skills: C#, SQL Server\nMust have\nJava",
        3: None,
    }
    texts = spark.createDataFrame(list(jobs.items()), "id long, text string")
    rows = op.sectioned(op.text_lines(texts, "text"), op.heading_table(spark, op.JOB_HEADINGS), "id")
    got = {}
    for r in op.job_items(rows, "id").orderBy("id", "section", "item", "part").collect():
        got.setdefault((r.id, r.label), []).append(r.text)
    assert got[1, "Responsibilities"] == ["Run clusters for many customers of ours", "Answer calls"]
    assert got[1, "Required Skills"] == ["AWS", "EC2", "Terraform"] and got[1, "Preferred Skills"] == ["Istio"]
    assert got[2, "Skills"] == ["C#", "SQL Server"] and got[2, "Required Skills"] == ["Java"]


def test_nothing(spark):
    texts = spark.createDataFrame([], "id long, text string")
    rows = op.sectioned(op.text_lines(texts, "text"), op.heading_table(spark, op.RESUME_HEADINGS), "id")
    assert op.sections(rows, "id").count() == op.experience(rows, "id").count() == op.education(rows, "id").count() == op.job_items(rows, "id").count() == 0
