"""What several test modules share."""

DATA = "/root/testdata/sf0.01"
