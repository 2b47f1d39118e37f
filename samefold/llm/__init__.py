"""Ten corpus-preparation operators; nothing outside this folder imports them."""
