"""Set-oriented rules over accounts, sessions and tokens."""
