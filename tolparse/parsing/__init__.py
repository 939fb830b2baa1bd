"""What runs in workers on one document at a time: lexing, nesting, parsing, tree rewriting."""
