"""Views that present the test tables as notes, chunks, links, commits and sessions."""
