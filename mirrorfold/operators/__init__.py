"""DataFrame-to-DataFrame operators. None of them runs a job unless it says so."""
