"""Column functions: text preparation, rules, URL checks, hashing, banks."""
