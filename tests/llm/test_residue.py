import pytest

from pothi.llm.residue import CORE, WORDS, Vocabulary, find_residue, residue_kind, without_residue

VOCABULARY = Vocabulary()
LESSON = "The quiet river divides the plateau. In Belcribel, a rural market was seen near the harbour. "


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("You need to enable JavaScript to run this book.", "message"),
        ("Skip to content\nAccess denied (403)\nYou may not open this chapter. Ticket 463", "message"),
        (LESSON + "\nGateway timeout after 3000 ms\n" + LESSON, "message"),
        ("রক্ষণাবেক্ষণ চলছে, ২০ মিনিট পরে ফিরে আসুন।", "message"),
        ("এখানে লেখা বসবে। এখানে লেখা বসবে।", "message"),
        (LESSON + "TODO: check figure 12.", "message"),
        ("In this chapter on {{ page_body }} you meet the warm wheel.", "place"),
        ("Written by __school__", "place"),
        ("Prepared on #summary#.", "place"),
        ("[এখানে বিষয় লিখুন] একটি দূরবর্তী রেখা (অধ্যায় দিতে হবে) এর কাছে রেখেছিল।", "place"),
        ("Dear {lesson_title},", "place"),
        ("%(topic)s", "place"),
        ("<date here>", "place"),
        ("word " * 20, "filler"),
        ("… " * 40, "filler"),
        ("- - - - - - - - - - end of dummy block", "filler"),
        ("qwer asdf blah zxcv hjkl test xxx asdf", "filler"),
        ("Belimgria yorfinbel boholnavus ranus lumcrius ner joroem wexdorem imdordaus.", "filler"),
        (LESSON * 3000 + "Bad gateway", "message"),
        (LESSON, None),
        ("Learners write “[name]” in the draft letter and swap it later, as in 3 of the tasks.", None),
        ("In a mail merge the learner types {{name}} where each guest will be named, and 849 letters come out filled in.", None),
        ("The code print(f\"{total} marks\") puts the value of total between the braces, here 43.", None),
        ("In the set {x, y, z} each letter names one massive enzyme.", None),
        ("The tag <roof> in the drawing is a label for the wire, and learners copy it as printed.", None),
        ("Too many requests at one counter slow the polished chart, and the same is true of a server.", None),
        ("The notice “please turn on JavaScript” is shown by 10 pages in the exercise; tell what each page is missing.", None),
        ("A plan may carry the word TODO beside work that is left, as the dusty cursor does in the story.", None),
        ("মেরামতের জন্য বড় স্তর বন্ধ ছিল, তাই দর্শক পরে ফিরে আসেন।", None),
        ("Readings:\n228\n331\n853", None),
        ("", None),
        (" \n ", None),
        (None, None),
    ],
)
def test_kind(text, kind):
    assert residue_kind(text, VOCABULARY) == kind


def test_tables(spark):
    rows = [(1, "Bad gateway", "x"), (2, "Bad gateway", "x"), (3, LESSON, "x"), (4, None, "x"), (5, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    assert {(r["doc_id"], r["kind"]) for r in find_residue(df).collect()} == {(1, "message"), (2, "message")}
    assert sorted(r["doc_id"] for r in without_residue(df).collect()) == [3, 4, 5]
    assert find_residue(df.limit(0)).count() == 0 and without_residue(df.limit(0)).count() == 0


# Messages of well-known servers and tools, none of them listed as a whole.
UNLISTED = (
    "502 Bad Gateway", "503 Service Unavailable", "504 Gateway Timeout", "404 Not Found", "403 Forbidden", "500 Internal Server Error", "429 Too Many Requests", "401 Unauthorized",
    "The requested URL was not found on this server.", "You don't have permission to access this page on this server.", "Error establishing a database connection", "Please enable cookies and reload the page.",
    "This site requires JavaScript to be enabled in your browser.", "JavaScript must be enabled to view this content.", "Your session has timed out. Please log in again.", "Sorry, this page is not available.",
    "The server is temporarily unable to handle your request. Please try again later.", "This content is not available in your country.", "Request timed out.", "An unexpected error has occurred.", "Connection failed. Check your network settings.",
    "The file could not be found.", "Loading, please wait...", "Something went wrong. Try again.", "Lorem ipsum dolor sit amet", "Placeholder text goes here.", "TODO: write this section", "Insert text here", "Content to be added.", "Coming soon!",
    "জাভাস্ক্রিপ্ট বন্ধ আছে।", "পৃষ্ঠাটি পাওয়া যায়নি।", "সার্ভারে ত্রুটি ঘটেছে, আবার চেষ্টা করুন।", "আপনার সেশন শেষ হয়েছে।", "পাতা লোড হচ্ছে, অপেক্ষা করুন।", "এখানে লেখা যোগ হবে।",
)
LESSONS = (
    "A server answers each request that a browser sends over the network.", "The error of a measurement is the difference between the reading and the true value.", "When a page is not found, the server answers with the number 404.",
    "If the session expired, the learner signs in again and goes on.", "The loading of the bridge is 40 tonnes at its centre.", "The carriage was blocked by a fallen tree near the gate.", "Access to clean water was denied to the village for years.",
    "JavaScript is a language that runs in the browser and moves pictures on a page.", "The experiment failed because the wire was too thin.", "A draft of air cools the sample before the final reading.", "He writes “TODO” beside the work that is left.",
    "ত্রুটি মানে মাপা মান আর আসল মানের পার্থক্য।", "সার্ভার নামের যন্ত্রটি অনেক কম্পিউটারের কাজ একসঙ্গে করে।", "নদীর পাড়ে নমুনা সংগ্রহ করে শিক্ষার্থীরা খাতায় লেখে।",
)


def test_messages_that_no_list_holds():
    missed = [t for t in UNLISTED if residue_kind(t, VOCABULARY) is None]
    assert len(missed) <= 0.1 * len(UNLISTED), missed
    assert [t for t in LESSONS if residue_kind(t, VOCABULARY) is not None] == []


@pytest.mark.parametrize("half", [0, 1])
def test_half_of_the_core_parts(half):
    """Messages have several core parts, so most are found with every second one alone, and no lesson is."""
    some = Vocabulary({k: v[half::2] for k, v in CORE.items()}, WORDS | {"core": " ".join(" ".join(v) for v in CORE.values())})
    found = sum(residue_kind(t, some) is not None for t in UNLISTED)
    false = sum(residue_kind(t, some) is not None for t in LESSONS)
    assert found >= 0.5 * len(UNLISTED) and found >= 0.95 * (found + false)
