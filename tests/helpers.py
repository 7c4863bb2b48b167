"""Small helpers of several test files."""


def ids(df):
    return {r.id for r in df.select("id").collect()}
