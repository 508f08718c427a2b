"""Where surveys come from and go to."""
