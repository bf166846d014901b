"""Named cases that queries deal out over the driver's rows: inputs, and what the rules say of them.

A query joins its rows with the cases by ``id % number of cases``; the SQL of the query joins
with the expected values, which are stated here and not computed by the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quoted(value: object) -> str:
    """A value as an SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value).lower() if isinstance(value, bool) else str(value)


def values(names: str, rows: list[tuple]) -> str:
    """``cases(k, names)`` as SQL."""
    body = ", ".join("(" + ", ".join(quoted(x) for x in (k, *row)) + ")" for k, row in enumerate(rows))
    return f"cases(k, {names}) AS (VALUES {body})"


def dealt(spark: SparkSession, rows: DataFrame, cases: list[tuple], schema: str) -> DataFrame:
    """``rows`` (with an id) beside the inputs of their case; the cases are a constant of the program."""
    table = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], f"k bigint, {schema}")
    return rows.join(F.broadcast(table), F.col("id") % len(cases) == F.col("k")).drop("k")


#: (text, title), then deadline, max_minutes, min_minutes, fee, fee_currency, ai_policy, premiere, eligibility; read on 2026-09-28.
_N = None
FIELDS: list[tuple[tuple, tuple]] = [
    # runtime
    (("Maximum film length: 15 minutes, credits included.", _N), (_N, 15, _N, _N, _N, _N, _N, "")),
    (("Durata massima 12 minuti.", _N), (_N, 12, _N, _N, _N, _N, _N, "")),
    (("Maximale Laufzeit von 30 Minuten", _N), (_N, 30, _N, _N, _N, _N, _N, "")),
    (("Durée: jusqu'à 20 minutes", _N), (_N, 20, _N, _N, _N, _N, _N, "")),
    (("Un court-métrage ne dépassant pas 18 minutes", _N), (_N, 18, _N, _N, _N, _N, _N, "")),
    (("Films shorter than 8 mins.", _N), (_N, 8, _N, _N, _N, _N, _N, "")),
    (("We take animated shorts, 25 min max", _N), (_N, 25, _N, _N, _N, _N, _N, "")),
    (("Videos between 3 and 12 minutes", _N), (_N, 12, 3, _N, _N, _N, _N, "")),
    (("단편 영상 최대 15분", _N), (_N, 15, _N, _N, _N, _N, _N, "")),
    (("作品は 10 分以内", _N), (_N, 10, _N, _N, _N, _N, _N, "")),
    (("작품 3-7분", _N), (_N, _N, _N, _N, _N, _N, _N, "")),
    (("영상 3 - 7 분", _N), (_N, 7, 3, _N, _N, _N, _N, "")),
    (("The hall is a 10-15 minutes walk away.", _N), (_N, _N, _N, _N, _N, _N, _N, "")),
    (('{"film": "up to 5 minutes", "x": [{"a": 1}]}', _N), (_N, _N, _N, _N, _N, _N, _N, "")),
    (("A film of up to 900 minutes", _N), (_N, _N, _N, _N, _N, _N, _N, "")),
    (("<p>Films of up to 5 minutes</p>", _N), (_N, _N, _N, _N, _N, _N, _N, "")),
    # fee
    (("Entry fee: €20 for each work.", _N), (_N, _N, _N, 20.0, "EUR", _N, _N, "")),
    (("Quota di iscrizione: 15,50 €", _N), (_N, _N, _N, 15.5, "EUR", _N, _N, "")),
    (("Frais d'inscription 12 euros", _N), (_N, _N, _N, 12.0, "EUR", _N, _N, "")),
    (("Regular fee is 30 dollars", _N), (_N, _N, _N, 30.0, "USD", _N, _N, "")),
    (("Application fee ₩5000", _N), (_N, _N, _N, 5000.0, "KRW", _N, _N, "")),
    (("The prize is free to enter.", _N), (_N, _N, _N, 0.0, _N, _N, _N, "")),
    (("Inscrição gratuita", _N), (_N, _N, _N, 0.0, _N, _N, _N, "")),
    (("Gratuita la partecipazione", _N), (_N, _N, _N, 0.0, _N, _N, _N, "")),
    (("Die Teilnahme ist gebührenfrei.", _N), (_N, _N, _N, 0.0, _N, _N, _N, "")),
    (("Entry fee €10. Gratis para estudiantes.", _N), (_N, _N, _N, _N, _N, _N, _N, "")),
    (("Early fee: $10. Late fee: $20", _N), (_N, _N, _N, _N, _N, _N, _N, "")),
    (("Fee: €30 until June / €45 after", _N), (_N, _N, _N, _N, _N, _N, _N, "")),
    (("In the exclusive category the fee is $50", _N), (_N, _N, _N, _N, _N, _N, _N, "")),
    (("Music videos have a submission fee of $40", _N), (_N, _N, _N, _N, _N, _N, _N, "")),
    # AI policy
    (("Non-AI footage may not be accepted.", _N), (_N, _N, _N, _N, _N, "required", _N, "")),
    (("Live-action material is prohibited.", _N), (_N, _N, _N, _N, _N, "required", _N, "")),
    (("Works by generative tools are banned.", _N), (_N, _N, _N, _N, _N, "restricted", _N, "")),
    (("We won't accept artificial intelligence", _N), (_N, _N, _N, _N, _N, "restricted", _N, "")),
    (("Sono esclusi, excluding intelligence artificielle", _N), (_N, _N, _N, _N, _N, "restricted", _N, "")),
    (("Entirely AI-generated pieces", _N), (_N, _N, _N, _N, _N, "required", _N, "")),
    (("Movies generated with gen-AI", _N), (_N, _N, _N, _N, _N, "required", _N, "")),
    (("Entrants must incorporate AI", _N), (_N, _N, _N, _N, _N, "required", _N, "")),
    (("A.I. tools are welcome here", _N), (_N, _N, _N, _N, _N, "allowed", _N, "")),
    (("We welcome AI-assisted animation", _N), (_N, _N, _N, _N, _N, "allowed", _N, "")),
    (("Our AI film festival returns.", "The AI Film Prize"), (_N, _N, _N, _N, _N, "required", _N, "")),
    (("Our AI film festival returns.", "The Lakeside Prize"), (_N, _N, _N, _N, _N, _N, _N, "")),
    (("Retaining the mailed tapes, training included", _N), (_N, _N, _N, _N, _N, _N, _N, "")),
    # premiere
    (("There is no premiere requirement", _N), (_N, _N, _N, _N, _N, _N, "none", "")),
    (("Première mondiale exigée", _N), (_N, _N, _N, _N, _N, _N, "world", "")),
    (("International and world premieres only", _N), (_N, _N, _N, _N, _N, _N, "world", "")),
    (("Only an international première is eligible", _N), (_N, _N, _N, _N, _N, _N, "international", "")),
    (("Se exige estreno europeo", _N), (_N, _N, _N, _N, _N, _N, "european", "")),
    (("North American premiere required", _N), (_N, _N, _N, _N, _N, _N, "national", "")),
    (("Latin American premieres must be shown", _N), (_N, _N, _N, _N, _N, _N, "national", "")),
    (("Prima italiana obbligatoria", _N), (_N, _N, _N, _N, _N, _N, "national", "")),
    (("A world premiere is not required", _N), (_N, _N, _N, _N, _N, _N, "none", "")),
    (("The world premiere of our opening night", _N), (_N, _N, _N, _N, _N, _N, _N, "")),
    (("World premiere required. National premiere required for students.", _N), (_N, _N, _N, _N, _N, _N, _N, "")),
    # eligibility
    (("Open to all filmmakers of any age.", _N), (_N, _N, _N, _N, _N, _N, _N, "Open to all filmmakers of any age")),
    (("Entries from around the world count.", _N), (_N, _N, _N, _N, _N, _N, _N, "Entries from around the world")),
    (("Applicants must be residents of Malta.", _N), (_N, _N, _N, _N, _N, _N, _N, "Applicants must be residents of Malta")),
    (("Ages 18 to 30 may apply", _N), (_N, _N, _N, _N, _N, _N, _N, "Ages 18 to 30 may apply")),
    (("First and second features only", _N), (_N, _N, _N, _N, _N, _N, _N, "First and second features only")),
    (("Films completed after 1 January 2025 are fine", _N), (_N, _N, _N, _N, _N, _N, _N, "completed after 1 January 2025 are fine")),
    (("No nationality restrictions. Debut film directors.", _N), (_N, _N, _N, _N, _N, _N, _N, "No nationality restrictions|Debut film directors")),
    # deadline
    (("Final deadline: October 15, 2026", _N), ("2026-10-15", _N, _N, _N, _N, _N, _N, "")),
    (("Deadline: 25/10/2026", _N), ("2026-10-25", _N, _N, _N, _N, _N, _N, "")),
    (("Deadline: 10/25/2026", _N), ("2026-10-25", _N, _N, _N, _N, _N, _N, "")),
    (("Deadline: 03/04/2027", _N), (_N, _N, _N, _N, _N, _N, _N, "")),
    (("締切: 2026年10月15日", _N), ("2026-10-15", _N, _N, _N, _N, _N, _N, "")),
    (("締め切り 2026 年 11 月 2 日", _N), ("2026-11-02", _N, _N, _N, _N, _N, _N, "")),
    (("마감 2026년 12월 1일", _N), ("2026-12-01", _N, _N, _N, _N, _N, _N, "")),
    (("Termine ultimo: 30 novembre 2026", _N), ("2026-11-30", _N, _N, _N, _N, _N, _N, "")),
    (("Cierre de la convocatoria: 15 de diciembre de 2026", _N), ("2026-12-15", _N, _N, _N, _N, _N, _N, "")),
    (("El plazo de inscripción de obras para esta edición del certamen finalizará el 27 de noviembre de 2026", _N), ("2026-11-27", _N, _N, _N, _N, _N, _N, "")),
    (("2026-10-15 · Late deadline", _N), ("2026-10-15", _N, _N, _N, _N, _N, _N, "")),
    (("Deadline last updated 26 September 2026", _N), (_N, _N, _N, _N, _N, _N, _N, "")),
    (("Submission deadline\n15 October 2026", _N), (_N, _N, _N, _N, _N, _N, _N, "")),
    (("Deadline: 31 February 2027", _N), (_N, _N, _N, _N, _N, _N, _N, "")),
    (("Early deadline: 1 October 2026. Late deadline: 30 November 2026.", _N), ("2026-11-30", _N, _N, _N, _N, _N, _N, "")),
    (("Deadline: 1 May 2020", _N), ("2020-05-01", _N, _N, _N, _N, _N, _N, "")),
    (("DEADLINES: Super Earlybird: May 31, 2026 Regular: September 30, 2026 Extended: December 31, 2026 AWARDS", _N), ("2026-12-31", _N, _N, _N, _N, _N, _N, "")),
    (("Fristen • Early: 1 May 2026\nNotification: 1 November 2026", _N), ("2026-05-01", _N, _N, _N, _N, _N, _N, "")),
    (("Regular: September 30, 2026 Late: November 30, 2026", _N), (_N, _N, _N, _N, _N, _N, _N, "")),
    (("Open now\nStoryLab 2027\nDeadline: 5 November 2026\nHarbour Grant", "Harbour Grant"), (_N, _N, _N, _N, _N, _N, _N, "")),
    (("Open now\nStoryLab 2027\nDeadline: 5 November 2026\nHarbour Grant", "StoryLab 2027"), ("2026-11-05", _N, _N, _N, _N, _N, _N, "")),
    (("Lagoon Shorts deadline: 1 October 2026.\n" + "and more " * 30 + "\nDeadline: 9 December 2026", "Lagoon Shorts"), ("2026-10-01", _N, _N, _N, _N, _N, _N, "")),
    (('{"deadline" : "2026-10-15"}', _N), (_N, _N, _N, _N, _N, _N, _N, "")),
    (("", ""), (_N, _N, _N, _N, _N, _N, _N, "")),
    ((_N, _N), (_N, _N, _N, _N, _N, _N, _N, "")),
]


#: Titles as they were found and the organizer; then clean_title, public_title and unresolved.
TITLES: list[tuple[tuple, tuple]] = [
    (("Home - Glasgow Short Film Festival", "Glasgow Film"), ("Glasgow Short Film Festival", "Glasgow Short Film Festival", False)),
    (("Welcome to the Lagoon Prize", ""), ("Lagoon Prize", "Lagoon Prize", False)),
    (("Night Owl Shorts | Accueil", "Owl"), ("Night Owl Shorts", "Night Owl Shorts", False)),
    (("Accueil » Rencontres du Lac", ""), ("Rencontres du Lac", "Rencontres du Lac", False)),
    (("Lagoon Prize – Final Deadline Today (Top 100)", ""), ("Lagoon Prize", "Lagoon Prize", False)),
    (("Lagoon Prize — Startseite", ""), ("Lagoon Prize", "Lagoon Prize", False)),
    (("Call for Entries 2027 is now open!", "Lagoon House"), ("", "Lagoon House", False)),
    (("Call for Entries 2027 is now open!", ""), ("", "", True)),
    (("Submissions for the 2027 Episodic Lab are now open", ""), ("2027 Episodic Lab", "2027 Episodic Lab", False)),
    (("Iscrizioni aperte per il Festival Roma", ""), ("Festival Roma", "Festival Roma", False)),
    (("Inscripciones abiertas para el Certamen Sur", ""), ("Certamen Sur", "Certamen Sur", False)),
    (("Inscriptions ouvertes pour le Prix du Lac", ""), ("Prix du Lac", "Prix du Lac", False)),
    (("Entries now open for the Lagoon Prize", ""), ("Lagoon Prize", "Lagoon Prize", False)),
    (("Call for submissions Lagoon Prize", ""), ("Lagoon Prize", "Lagoon Prize", False)),
    (("Lagoon Prize – Harbour House", "Harbour House"), ("Lagoon Prize", "Lagoon Prize", False)),
    (("Cine – Harbour House", "Harbour House"), ("Cine – Harbour House", "Cine – Harbour House", False)),
    (("Caf&eacute; &amp; Cin&eacute;ma &mdash; Lyon &#38; Co &#x41;", ""), ("Café & Cinéma — Lyon & Co A", "Café & Cinéma — Lyon & Co A", False)),
    (("Fest &unknown; &laquo;Nuit&raquo;&nbsp;2027", ""), ("Fest &unknown; «Nuit» 2027", "Fest &unknown; «Nuit» 2027", False)),
    (("Submit", "Harbour House"), ("Submit", "Harbour House", False)),
    (("Submit your screenplay", "Harbour House"), ("Submit your screenplay", "Harbour House – screenplay", False)),
    (("Rules and Regulations – Lagoon Prize", "Harbour House"), ("Rules and Regulations – Lagoon Prize", "Harbour House – Lagoon Prize", False)),
    (("Lagoon Prize Submission Form", "Harbour House"), ("Lagoon Prize Submission Form", "Lagoon Prize", False)),
    (("Main Competition", "Harbour Filmfest"), ("Main Competition", "Harbour Filmfest – Main Competition", False)),
    (("Student Short Competition 2027", "Harbour Filmfest"), ("Student Short Competition 2027", "Harbour Filmfest – Student Short Competition 2027", False)),
    (("Main Competition", "unknown organizer"), ("Main Competition", "Main Competition", True)),
    (("Main Competition", "harbour-fest.org"), ("Main Competition", "Main Competition", True)),
    (("The Festival in Numbers", "Harbour House"), ("The Festival in Numbers", "Harbour House", False)),
    (("About us", ""), ("About us", "About us", True)),
    (("Desert Nights G O L D E N", ""), ("Desert Nights G O L D E N", "Desert Nights", False)),
    (("Open Call: Harbour Residency", "Harbour House"), ("Open Call: Harbour Residency", "Harbour Residency", False)),
    (("Rules of the Game Fest", "Other House"), ("Rules of the Game Fest", "Rules of the Game Fest", False)),
    ((None, None), ("", "", True)),
]

#: A record that is approved as it stands on 2026-10-01, and its page; cases say what differs.
RECORD = {
    "title": "Harbour Light Film Prize 2027", "organizer": "Harbour Light", "summary": "A prize for short films", "category": "Traditional festival", "deadline": "2026-11-20 00:00:00", "deadline_status": "confirmed", "official_url": "https://www.harbourlight.org/call",
    "official_url_status": "verified", "source_url": "https://list.example.org/a", "source_url_status": "verified", "source_type": "official", "application_url": None, "has_conflict": False, "confidence": 0.8, "review_reason": None, "status": "discovered", "tags": "",
}
CHECK = {
    "ok": True, "http_status": 200, "final_url": "https://www.harbourlight.org/call", "closed": False, "call_signal": True, "date_found": True, "open_found": False, "film": True, "all_disciplines": False, "other_only": False, "directory": False, "year_found": True, "organizer": None,
}
_PLAIN = {"summary": "", "category": "Residency", "organizer": "Harbour Light"}
#: (changes of the record, changes of the page (None: no page), duplicate, quoted as open), then decision, target, reasons, title, organizer and category.
REVIEWS: list[tuple[tuple, tuple]] = [
    (({}, {}, False, False), ("approve", "open", "", _N, _N, _N)),
    (({"deadline": "2026-10-12 00:00:00"}, {}, False, False), ("approve", "closing-soon", "", _N, _N, _N)),
    (({"deadline_status": "estimated"}, {}, False, False), ("approve", "verified", "", _N, _N, _N)),
    (({"deadline": _N, "deadline_status": "rolling"}, {"date_found": False}, False, False), ("approve", "open", "", _N, _N, _N)),
    (({"deadline": _N, "deadline_status": "rolling"}, {"year_found": False}, False, False), ("human", _N, "year-not-on-page", _N, _N, _N)),
    (({"deadline": _N, "deadline_status": "unknown", "application_url": "https://filmfreeway.com/h"}, {"open_found": True, "date_found": False}, False, True), ("approve", "verified", "", _N, _N, _N)),
    (({"deadline": _N, "deadline_status": "unknown", "application_url": "https://filmfreeway.com/h"}, {"open_found": False, "year_found": False}, False, True), ("human", _N, "open-statement-not-on-page,year-not-on-page", _N, _N, _N)),
    (({"deadline": _N, "deadline_status": "unknown", "application_url": "https://filmfreeway.com/h"}, {}, False, False), ("watch", _N, "no-actionable-deadline", _N, _N, _N)),
    (({"deadline": "2026-10-02 12:00:00"}, {}, False, False), ("watch", _N, "no-actionable-deadline", _N, _N, _N)),
    (({"organizer": "Unknown organizer"}, {"organizer": "Harbour Light | Home"}, False, False), ("approve", "open", "", _N, "Harbour Light", _N)),
    (({"organizer": "Unknown organizer"}, {}, False, False), ("human", _N, "organizer-unknown", _N, _N, _N)),
    (({"organizer": "Harbour Light | News"}, {}, False, False), ("approve", "open", "", _N, "Harbour Light", _N)),
    (({"title": "Main Competition", "organizer": "Harbour Light Filmfest"}, {}, False, False), ("approve", "open", "", "Harbour Light Filmfest – Main Competition", _N, _N)),
    (({"title": "Harbour Light AI Cinema Prize"}, {}, False, False), ("approve", "open", "", _N, _N, "AI film festival")),
    (({"tags": "short,festhome:77"}, {}, False, False), ("watch", _N, "team-only", _N, _N, _N)),
    (({"source_url": "https://www.festhome.com/f/1"}, {}, False, False), ("watch", _N, "team-only", _N, _N, _N)),
    (({"title": "Late Deadline: Jan 10"}, {}, False, False), ("reject", _N, "generic-title", _N, _N, _N)),
    (({}, {}, True, False), ("archive", _N, "duplicate", _N, _N, _N)),
    (({"title": "Open Calls | Harbour Light"}, {}, False, False), ("reject", _N, "listing-title", _N, _N, _N)),
    (({"title": "Harbour data API for film"}, {}, False, False), ("reject", _N, "listing-title", _N, _N, _N)),
    (({"title": "Festival Submissions & Deadlines 2026"}, {}, False, False), ("reject", _N, "listing-title", _N, _N, _N)),
    (({"title": "Grants and awards of the harbour"}, {}, False, False), ("reject", _N, "listing-title", _N, _N, _N)),
    (({"title": "Jury accreditation"}, {}, False, False), ("reject", _N, "not-a-call", _N, _N, _N)),
    (({**_PLAIN, "title": "Harbour Poetry Prize", "category": "Grant"}, {"film": False}, False, False), ("reject", _N, "other-discipline", _N, _N, _N)),
    (({**_PLAIN, "title": "Harbour Residency"}, {"film": False, "other_only": True}, False, False), ("reject", _N, "other-discipline", _N, _N, _N)),
    (({**_PLAIN, "title": "Harbour Poetry Prize"}, {"film": False, "all_disciplines": True}, False, False), ("approve", "open", "", _N, _N, _N)),
    (({**_PLAIN, "title": "Harbour Residency"}, {"film": False}, False, False), ("human", _N, "no-film-relevance", _N, _N, _N)),
    (({"title": "Harbour Théâtre Prize"}, {}, False, False), ("reject", _N, "performing-arts", _N, _N, _N)),
    (({"title": "Harbour Dance Film Prize"}, {}, False, False), ("approve", "open", "", _N, _N, _N)),
    (({"title": "Selected films 2027"}, {}, False, False), ("reject", _N, "past-edition", _N, _N, _N)),
    (({"title": "Program schedule of the harbour"}, {}, False, False), ("reject", _N, "past-edition", _N, _N, _N)),
    (({"title": "Harbour quarter-finalists"}, {}, False, False), ("reject", _N, "past-edition", _N, _N, _N)),
    (({"title": "Harbour Light 2024/2025"}, {}, False, False), ("reject", _N, "past-edition", _N, _N, _N)),
    (({"title": "Harbour Light Residency (2025–2027)"}, {}, False, False), ("approve", "open", "", _N, _N, _N)),
    (({}, {"directory": True}, False, False), ("reject", _N, "directory-page", _N, _N, _N)),
    (({"title": "Film submissions closed"}, {}, False, False), ("reject", _N, "closed-title", _N, _N, _N)),
    (({"title": "Convocatoria cerrada: Harbour"}, {}, False, False), ("reject", _N, "closed-title", _N, _N, _N)),
    (({"title": "Harbour Light: próximamente"}, {}, False, False), ("watch", _N, "not-yet-open", _N, _N, _N)),
    (({"official_url": "https://www.harbourlight.org/news/"}, {}, False, False), ("human", _N, "listing-url", _N, _N, _N)),
    (({"official_url": "https://www.harbourlight.org/news/a-workshop"}, {}, False, False), ("human", _N, "news-post", _N, _N, _N)),
    (({"official_url": "https://www.harbourlight.org/news/call-for-films-is-open"}, {}, False, False), ("approve", "open", "", _N, _N, _N)),
    (({"official_url": "https://www.filmmagazine.org/blog/harbour-call"}, {}, False, False), ("human", _N, "news-post,domain-mismatch", _N, _N, _N)),
    (({"organizer": "Harbour Guide", "title": "Lagoon Film Prize"}, {}, False, False), ("human", _N, "domain-mismatch", _N, _N, _N)),
    (({"organizer": "European Commission", "title": "Media Development", "official_url": "https://ec.europa.eu/calls/x"}, {}, False, False), ("approve", "open", "", _N, _N, _N)),
    (({"has_conflict": True}, {}, False, False), ("human", _N, "conflict,unresolved-conflict", _N, _N, _N)),
    (({"review_reason": "possible false-positive candidate", "confidence": 0.4}, {}, False, False), ("human", _N, "false-positive-flag,low-confidence", _N, _N, _N)),
    (({"source_type": "press", "official_url_status": "invalid"}, {"ok": False, "http_status": 503}, False, False), ("human", _N, "page-not-ok,no-verified-official-page", _N, _N, _N)),
    (({}, {"closed": True, "call_signal": False, "date_found": False}, False, False), ("human", _N, "page-closed,no-call-signal,deadline-not-on-page", _N, _N, _N)),
    (({}, _N, False, False), ("human", _N, "page-not-ok", _N, _N, _N)),
    (({"official_url": _N, "official_url_status": "unchecked", "source_type": "press"}, {}, False, False), ("approve", "open", "", _N, _N, _N)),
]
REVIEW_RECORD = "title string, organizer string, summary string, category string, deadline string, deadline_status string, official_url string, official_url_status string, source_url string, source_url_status string, source_type string, application_url string, has_conflict boolean, confidence double, review_reason string, status string, tags string"

PLACES = {
    "USA / Canada": "USA,United States,Toronto (Canada),North America",
    "Latin America / Caribbean": "México,Latin America,South America,Central America,Caribbean,Argentina,Bolivia,Brazil,Brasil,Chile,Colombia,Costa Rica,Cuba,Ecuador,Guatemala,Panamá,Paraguay,Perú,Puerto Rico,Uruguay,Venezuela",
    "Middle East": "MENA,Middle East,Qatar,UAE,United Arab Emirates,Bahrain,Iran,Iraq,Israel,Jordan,Kuwait,Lebanon,Oman,Palestine,Saudi Arabia,Syria,Yemen",
    "Oceania": "Australia,New Zealand,Oceania,Pacific Island,Pacific Islands",
    "Africa": "Africa,Algeria,Angola,Cameroon,Egypt,Ethiopia,Ghana,Kenya,Morocco,Nigeria,Senegal,South Africa,Tunisia,Uganda,Zimbabwe",
    "Asia": "Asia,Japan,China,Hong Kong,India,Indonesia,Seoul KOREA,Malaysia,Philippines,Singapore,Taiwan,Thailand,Vietnam",
    "Europe": "Europe,EU,UK,United Kingdom,England,Scotland,Wales,Ireland,Roma Italy,France,Germany,Spain,Portugal,Austria,Belgium,Bulgaria,Croatia,Czech Republic,Denmark,Finland,Greece,Hungary,Iceland,Netherlands,Norway,Poland,Romania,Serbia,Slovakia,Slovenia,Sweden,Switzerland",
    "Global / International": "Global,International",
    "Other / Unclassified": "Atlantis,Romany,Chinatown",
    "Unknown": "",
}
GEOGRAPHY = [((name,), (group,)) for group, names in PLACES.items() for name in names.split(",")]

#: Page texts; then what they are about, and whether they speak of AI film.
SUBJECTS: list[tuple[tuple, tuple]] = [
    (("A festival of films",), ("film", False)), (("Media-art and video art",), ("film", False)), (("Un court-métrage",), ("film", False)), (("largometrajes",), ("film", False)), (("cine documental",), ("film", False)), (("映画祭",), ("film", False)), (("영화제",), ("film", False)),
    (("Artists from any discipline may apply; artists of all disciplines",), ("all", False)), (("Todas las disciplinas",), ("all", False)), (("toutes les disciplines",), ("all", False)), (("alle künstlerischen Sparten",), ("all", False)), (("cross-disciplinary work",), ("all", False)), (("every art form",), ("all", False)),
    (("A poetry and comics prize",), ("other", False)), (("イラスト募集",), ("other", False)), (("写真コンテスト",), ("other", False)), (("Architecture models",), ("other", False)), (("Nothing about anything",), ("none", False)), (("The display screen readers",), ("none", False)),
    (("An AI advert contest",), ("none", True)), (("an AI ad for films",), ("film", True)), (("AI additions",), ("none", False)), (("Festival de cortos con inteligencia artificial",), ("none", True)), (("cine hecho con IA",), ("none", True)), (("KI-Kurzfilm",), ("film", True)), (("AI映画",), ("film", True)),
    (("Generative video",), ("none", True)), (("made with AI",), ("none", True)), (("intelligence artificielle",), ("none", True)), (("AI-assisted work",), ("none", True)), (("said films",), ("film", False)),
]

#: Pages of grants as (text, html, text and URL of a link); then title, opening, closing, closing_quote, status, funder, link.
GRANTS: list[tuple[tuple, tuple]] = [
    (("Menu Scheda bando Aperto Apertura sessioni: 01.03.2026 Scadenza  sessioni: 30.04.2026 Contatti dell'ente Regione Puglia Telefono 1", "<h1>Bando <b>Corti</b> &egrave; 2026</h1>", "Link al bando", "https://regione.it/b"), ("Bando Corti 2026", "2026-03-01", "2026-04-30", "Scadenza sessioni: 30.04.2026", "Aperto", "Regione Puglia", "https://regione.it/b")),
    (("Scheda bando In arrivo Scadenza sessioni: 31.02.2026 Contatti dell'ente Mario Rossi Email a@b", "<title>Fondo | Italia</title>", "LINK AL BANDO", "https://www.italyformovies.it/x"), ("Fondo", _N, _N, "Scadenza sessioni: 31.02.2026", "In arrivo", _N, _N)),
    (("Chiuso. Contatti dell'ente Cineteca Film Commission Responsabile x", "<h1> </h1><title> Premio </title>", "altro", "https://a.it/"), ("Premio", _N, _N, _N, "Chiuso", "Cineteca Film Commission", _N)),
    (("", "", "", ""), (_N, _N, _N, _N, _N, _N, _N)),
    ((_N, _N, _N, _N), (_N, _N, _N, _N, _N, _N, _N)),
]

#: Leads as (name, URL, title of the result); then whether it is the call's own page.
LEADS: list[tuple[tuple, tuple]] = [
    (("AI Horizons Parma", "https://parma360.it/wp-content/uploads/ai-horizons-parma.pdf", ""), (True,)), (("AI Horizons Parma", "https://parma360.it/docs/x.pdf", "Bando Horizons Parma"), (True,)), (("AI Horizons Parma", "https://parma360.it/x/horizons-parma.pdf", ""), (False,)),
    (("Höhen Kurz Preis", "https://hoehen.de/hohen-kurz-preis", ""), (True,)), (("Aurora Lab", "https://site.org/en/aurora-lab-2026/", ""), (True,)), (("Aurora Lab", "https://site.org/news/aurora-lab/", ""), (False,)), (("Aurora Lab", "https://site.org/2026/03/aurora-lab", ""), (False,)),
    (("Aurora Lab", "https://site.org/other", "Aurora Lab"), (False,)), (("Aurora Lab", "https://x.blogspot.com/aurora-lab", ""), (False,)), (("Aurora Lab", "https://www.blocked.org/aurora-lab", ""), (False,)), (("Aurora Lab", "not a url", ""), (False,)), (("AI", "https://site.org/ai", ""), (False,)),
    (("Aurora Lab", _N, _N), (False,)),
]

_LD = '<script type="application/ld+json">{"@type": "Festival", "name": "Lagoon Film Festival", "organizer": {"name": "Lagoon House"}}</script>'
#: Pages as (html, text, links as text>url joined by blanks, deadline); then disposition, reason, title, organizer, category, application, remote, status.
EXTRACTIONS: list[tuple[tuple, tuple]] = [
    (("<h1>Harbour Film Prize</h1>", "Submissions are open worldwide.", "Apply>https://h.org/apply", _N), ("complete", "VISIBLE_DETAIL_PAGE", "Harbour Film Prize", "Unknown organizer", "Traditional festival", "https://h.org/apply", True, "open")),
    ((_LD + "<h1>Home</h1>", "Entries are closed.", "", "2026-05-01"), ("complete", "VISIBLE_DETAIL_PAGE", "Lagoon Film Festival", "Lagoon House", "Traditional festival", _N, False, "closed")),
    (('<meta property="og:site_name" content="Home"><title>Residency of the Lake</title>', "An open call. Submissions are open. Entries are closed.", "", _N), ("complete", "VISIBLE_DETAIL_PAGE", "Residency of the Lake", "Unknown organizer", "Residency", _N, False, _N)),
    (("<h1>Commercial challenge</h1>", "no", "Register>https://c.org/r", _N), ("complete", "VISIBLE_DETAIL_PAGE", "Commercial challenge", "Unknown organizer", "Advertising competition", "https://c.org/r", False, _N)),
    (("<h1>AI film awards</h1>", "remote", "", "2026-05-01"), ("complete", "VISIBLE_DETAIL_PAGE", "AI film awards", "Unknown organizer", "AI film festival", _N, True, _N)),
    (("<h1>Creator challenge</h1>", "x", "", "2026-05-01"), ("complete", "VISIBLE_DETAIL_PAGE", "Creator challenge", "Unknown organizer", "Platform challenge", _N, False, _N)),
    (("<h1>Fondo de cine, premio</h1>", "x", "", "2026-05-01"), ("complete", "VISIBLE_DETAIL_PAGE", "Fondo de cine, premio", "Unknown organizer", "Grant", _N, False, _N)),
    (("<h1>Harbour Film Prize</h1>", "Nothing more.", "About>https://h.org/x", _N), ("ambiguous", "NO_APPLICATION_OR_DEADLINE", _N, _N, _N, _N, _N, _N)),
    (("<h1>Open calls 2026</h1>", "x", "Apply>https://h.org/apply", _N), ("ambiguous", "NO_STRONG_TITLE_SIGNAL", _N, _N, _N, _N, _N, _N)),
    (("<h1>Our garden</h1>", "x", "Apply>https://h.org/apply", _N), ("ambiguous", "NO_STRONG_TITLE_SIGNAL", _N, _N, _N, _N, _N, _N)),
    (("<h1>Prize directory</h1>", "x", "Apply>https://h.org/1 Submit>https://h.org/2 Entries>https://h.org/3", _N), ("ambiguous", "MULTI_ITEM_DIRECTORY", _N, _N, _N, _N, _N, _N)),
    (("<h1>Prizes of the harbour prize</h1>", "x", " ".join(f"Apply>https://h.org/{i}" for i in range(11)), _N), ("ambiguous", "MULTI_ITEM_DIRECTORY", _N, _N, _N, _N, _N, _N)),
    (("", "", "", _N), ("ambiguous", "NO_STRONG_TITLE_SIGNAL", _N, _N, _N, _N, _N, _N)),
]

#: Pages as (text, validThrough); then the best deadline on 2026-03-01, its status and method.
HUNTED: list[tuple[tuple, tuple]] = [
    (("Deadline: 20 May 2026", "2026-06-01T10:00"), ("2026-05-20", "confirmed", "dated")), (("Deadline: 20 May 2025", "2026-06-01T10:00"), ("2026-06-01", "confirmed", "json-ld")), (("Deadline: 20 May 2025. Deadline: 15 June, edition 2026", _N), ("2026-06-15", "estimated", "year-inferred")),
    (("Deadline 28 February 2026", _N), ("2026-02-28", "confirmed", "dated")), (("Deadline 27 February 2026", "2026-02-27"), (_N, _N, _N)), (("Deadline: 15 June", _N), (_N, _N, _N)), (("nothing", "soon"), (_N, _N, _N)), ((_N, _N), (_N, _N, _N)),
]

#: Secrets as pasted, and cleaned.
SECRETS: list[tuple[tuple, tuple]] = [
    (("  abc ",), ("abc",)), (('API_KEY = "abc"',), ("abc",)), (("bearer abc",), ("abc",)), (("KEY=Bearer `abc`",), ("abc",)), (("''",), (_N,)), (("",), (_N,)), (("Key=abc",), ("Key=abc",)), ((_N,), (_N,)),
]

#: Ingest requests as (authorized, body); then status and records accepted.
INGESTS: list[tuple[tuple, tuple]] = [
    ((True, '[{"a": 1}, {"b": 2}]'), (200, 2)), ((False, '[{"a": 1}]'), (401, 0)), ((_N, "x"), (401, 0)), ((True, "not json"), (400, 0)), ((True, "[]"), (400, 0)), ((True, '{"a": 1}'), (400, 0)), ((True, "[" + ",".join(["1"] * 250) + "]"), (200, 250)), ((True, "[" + ",".join(["1"] * 251) + "]"), (400, 0)), ((True, _N), (400, 0)),
]

_PAGE = "<h1>Harbour Film Prize</h1>"
#: Pages as (html, text, title, links, preset, answer) at https://h.org/call; then source, code, title, organizer, category, deadline, deadline_status, fee, currency, max_minutes, ai_policy, official_url on 2026-03-01.
PROCESSED: list[tuple[tuple, tuple]] = [
    ((_PAGE, "Run by Harbour House. Deadline: 20 May 2026. Entry fee: €20. Films up to 15 minutes. AI-generated films are not accepted.", "Harbour Film Prize", "Apply>https://h.org/apply", _N, _N), ("visible", _N, "Harbour Film Prize", "Unknown organizer", "Traditional festival", "2026-05-20", "confirmed", 20.0, "EUR", 15, "restricted", "https://h.org/call")),
    ((_PAGE, "Submissions are open. Deadline: 15 June, edition 2026.", "Harbour Film Prize", "Apply>https://h.org/apply", _N, _N), ("visible", _N, "Harbour Film Prize", "Unknown organizer", "Traditional festival", "2026-06-15", "estimated", _N, _N, _N, _N, "https://h.org/call")),
    ((_PAGE, "Lagoon Grant by Lagoon House. Deadline: 20 May 2026.", "Lagoon Grant", "", '[{"title": "Lagoon Grant", "organizer": "Lagoon House", "official": "https://h.org/call"}]', _N), ("preset", _N, "Lagoon Grant", "Lagoon House", "Grant", "2026-05-20", "confirmed", _N, _N, _N, _N, "https://h.org/call")),
    (("<h1>Our garden</h1>", "Aurora Lab by Aurora House. Entry fee: €20. Films up to 15 minutes", "Our garden", "", _N, '[{"title": "Aurora Lab", "organizer": "Nobody Known", "category": "Residency", "fee": "5", "currency": "usd"}]'), ("model", _N, "Aurora Lab", "Unknown organizer", "Residency", _N, "unknown", 5.0, "USD", 15, _N, _N)),
    (("<h1>Our garden</h1>", "Aurora Lab film", "Our garden", "", _N, '[{"title": "Winter Lab film"}]'), ("model", "UNGROUNDED_TITLE", _N, _N, _N, _N, _N, _N, _N, _N, _N, _N)),
    (("<h1>Our garden</h1>", "text", "Our garden", "", _N, "[]"), ("model", "NOT_RELEVANT", _N, _N, _N, _N, _N, _N, _N, _N, _N, _N)),
    (("<h1>Our garden</h1>", "text", "Our garden", "", _N, _N), ("none", "NO_STRONG_TITLE_SIGNAL", _N, _N, _N, _N, _N, _N, _N, _N, _N, _N)),
    (("<h1>Our garden</h1>", "text about a late deadline", "Our garden", "", '[{"title": "Late deadline"}]', _N), ("preset", "GENERIC_TITLE", _N, _N, _N, _N, _N, _N, _N, _N, _N, _N)),
    (("<h1>Harbour Film Prize</h1>", "Apply. Deadline: 20 February 2026.", "Harbour Film Prize", "Apply>https://h.org/apply", '[{"title": "Harbour Film Prize", "deadline": "2026-02-20"}]', _N), ("preset", _N, "Harbour Film Prize", "Unknown organizer", "Traditional festival", _N, "unknown", _N, _N, _N, _N, _N)),
]
